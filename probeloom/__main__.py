from probeloom.cli import main

raise SystemExit(main())
