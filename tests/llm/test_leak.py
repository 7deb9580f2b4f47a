import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from probeloom.llm import leak, queries

SF = "/root/testdata/sf0.01"
words = st.lists(st.sampled_from("abcd"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), st.lists(st.sampled_from("abcde"), max_size=30))
def test_stream_gives_the_longest_passages(items, page):
    ids = {w: n for n, w in enumerate("abcde")}
    auto = leak.Automaton([[ids[w] for w in i] for i in items])
    inside = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
    longest = [max((n for n in range(1, i + 2) if tuple(page[i + 1 - n : i + 1]) in inside), default=0) for i in range(len(page))]
    got = list(auto.stream([ids[w] for w in page]))
    assert [n for _, n in got] == longest
    for i, (state, n) in enumerate(got):
        if n:
            passage = page[i + 1 - n : i + 1]
            assert auto.holders(state) == {k for k, item in enumerate(items) for p in range(n - 1, len(item)) if item[p + 1 - n : p + 1] == passage}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 14), unique=True, max_size=6), max_size=26), max_size=4))
def test_pairs_of_pieces(pages):
    """What can follow what, and what wraps, against all pairs."""
    at = [(n, y, x, len(rows)) for n, rows in enumerate(pages) for y, row in enumerate(rows) for x in sorted(row)]
    page, line, column, lines = (np.array([p[k] for p in at], dtype=np.int64) for k in range(4))
    follow, wrap = [], []
    for b, (n, y, x, height) in enumerate(at):
        for a, (m, above, beside, _) in enumerate(at):
            if n == m and (y == above and beside < x <= beside + leak.JUMP + 1 or y == above + 1 and abs(x - beside) <= leak.JUMP or x == beside and above < y <= above + leak.JUMP + 1):
                follow.append((a, b))
            if n == m and above >= height - leak.JUMP and y <= leak.JUMP and (beside < x or beside == x == 0) and x <= beside + leak.JUMP + 1:
                wrap.append((a, b))
    count, which, wrapped = leak.successions(page, line, column, lines)
    pairs = list(zip(np.repeat(np.arange(len(at)), count).tolist(), which.tolist()))
    assert sorted(p for p, w in zip(pairs, wrapped.tolist()) if not w) == sorted(follow)
    assert sorted(p for p, w in zip(pairs, wrapped.tolist()) if w) == sorted(wrap)
    layout = leak.Layout(page, count, which, wrapped)
    for n in range(len(pages)):
        low = sum(p < n for p in page.tolist())
        for got, want in zip(layout.of(n), (follow, [p for p in wrap if p[0] != p[1]])):
            assert {(a + low, b + low) for b, before in enumerate(got) for a in before} == {p for p in want if at[p[0]][0] == n}


ITEM = "In the annals of Gidtor the festival of Selnov is called Nirgev because Sarlat once measured Nistuv since Virsel drowned"
OTHER = "In the annals of Kusgut the brewery of Malvam is called Tedfat because Lonrad once painted Gevlon since Rimdin drowned"


def whole(known, text):
    """Longest runs by item number, of all items and however easy their words are."""
    pieces, lines = leak.pieces_of(text)
    line, column = (np.array([p[k] for p in pieces], dtype=np.int64) for k in (0, 1))
    page = np.zeros(len(pieces), dtype=np.int64)
    layout = leak.Layout(page, *leak.successions(page, line, column, np.full(len(pieces), lines)))
    return known.read(pieces, *layout.of(0))


def run(text, item=ITEM):
    return whole(leak.Items([(1, item)], 1), text).get(0, 0)


def brute_easy(text, item):
    """Most words of the item in a row that are no more than misread, or parted at a piece's end as they are."""
    words = leak.item_words(item)
    pieces, _ = leak.pieces_of(text)
    ends, heads, best = [], [], 0
    for b, (line, column, piece, broken) in enumerate(pieces):
        entering, joined = {}, []
        for a in range(b):
            above, beside = pieces[a][:2]
            if above < line <= above + leak.JUMP + 1 and (column == beside or line == above + 1) or above == line and column > beside:
                for j, n in ends[a].items():
                    entering[j] = max(n, entering.get(j, 0))
                joined += [heads[a]] if heads[a] else []
        before = before2 = entering
        for i, printed in enumerate(piece):
            now = {j: before.get(j - 1, 0) + 1 for j, w in enumerate(words) if leak.same_word(printed, w)}
            for start, earlier in joined if not i else ():
                for j, w in enumerate(words):
                    if leak.folded(start + printed) == leak.folded(w) or leak.key(start + printed) == leak.key(w) != "":
                        now[j] = max(now.get(j, 0), earlier.get(j - 1, 0) + 1)
            best = max([best, *now.values()])
            before, before2 = now, before
        ends.append(before)
        heads.append((piece[-1], before2) if broken else None)
    return best


def brute_run(text, item):
    """Longest run of one item but for foot to head: every way through the page, place by place, without an automaton."""
    words = leak.item_words(item)
    pieces, _ = leak.pieces_of(text)
    ends, heads, best = [], [], 0

    def grow(now, j, run):
        now.setdefault(j, set()).add(run)

    def walk(piece, entering, joined, fresh=True):
        nonlocal best
        before, before2 = entering, {}
        for i, printed in enumerate(piece):
            now = {}
            for j, word in enumerate(words):
                runs = before.get(j - 1, set())
                if leak.same_word(printed, word):
                    for n, since in {*runs, *([(0, 0)] if fresh else [])}:
                        grow(now, j, (n + 1, since + 1))
                if j and leak.same_word(printed, words[j - 1] + word):
                    for n, since in {*before.get(j - 2, set()), *([(0, 0)] if fresh else [])}:
                        grow(now, j, (n + 2, since + 2))
                for start, earlier in joined if not i else [(piece[i - 1], before2)]:
                    equal = start + printed in (word,) or leak.folded(start + printed) == leak.folded(word) or leak.key(start + printed) == leak.key(word) != ""
                    near = leak.same_word(start + printed, word) and abs(len(word) - len(start + printed)) <= 2
                    for n, since in {*earlier.get(j - 1, set()), *([(0, 0)] if fresh else [])}:
                        if equal or near and n >= 2:
                            grow(now, j, (n + 1, since + 1))
            best = max([best, *(n for at in now.values() for n, _ in at)])
            for j, runs in before.items():
                if j + 1 < len(words) and leak.near_word(printed, words[j + 1]):
                    for n, since in runs:
                        if since >= leak.STEADY:
                            grow(now, j + 1, (n + 1, 0))
            before, before2 = now, before
        return before, before2

    for b, (line, column, piece, broken) in enumerate(pieces):
        entering, joined = {}, []
        for a in range(b):
            above, beside = pieces[a][:2]
            if above < line <= above + leak.JUMP + 1 and (column == beside or line == above + 1) or above == line and column > beside:
                for j, runs in ends[a].items():
                    for r in runs:
                        grow(entering, j, r)
                if heads[a]:
                    joined.append(heads[a])
        end, earlier = walk(piece, entering, joined)
        ends.append(end)
        heads.append((piece[-1], earlier) if broken else None)
    return best


def test_layouts_and_misprints():
    filler = "Rain fell without delay upon the rival census of Torsar"
    assert run(ITEM) == 20
    assert run(ITEM.upper().replace(" ", ", ")) == 20
    assert run("x\n" + ITEM.replace(" ", "\n") + "\ny") == 20
    broken = "In the annals of Gid-\ntor the festi-\nval of Selnov is cal¬\nled Nirgev because Sar\xad\nlat once measured Nistuv since Virsel drowned"
    assert run(broken) == 20
    gap = "In the annals of Gidtor the  |  " + filler[:24] + "\nfestival of Selnov is called  |  " + filler[24:] + "\nNirgev because Sarlat once  |  nothing here\nmeasured Nistuv since Virsel drowned"
    assert run(gap) == 20
    lines = ["In the annals of Gidtor the", "Rain fell without", "festival of Selnov is called", "delay upon the rival", "GREAT SALE", "Nirgev because Sarlat once", "census of Torsar", "measured Nistuv since Virsel drowned"]
    assert run("\n".join(lines)) == 20
    assert run(ITEM.replace("Selnov", "SeInov").replace("annals", "annols").replace("called", "callecl").replace("festival of", "festivalof")) == 20
    assert run("In the annals of Gidtor thé festival of Selnov is called Nirgev becauſe Sarlat once") == 15
    assert run(OTHER) < 8 and run(filler) <= 2 and run("") == 0
    assert run("quel préfet né à Longev rÃ©para la bibliothÃ¨que", "quel préfet né à Longev répara la bibliothèque") == 8


def test_wrap_from_foot_to_head():
    left = [f"foreign words {i}" for i in range(14)] + ["In the annals of Gidtor the"]
    right = ["festival of Selnov is called", "Nirgev because Sarlat once"] + [f"other text {i}" for i in range(13)]
    assert run("\n".join(f"{a}   {b}" for a, b in zip(left, right))) == 15
    assert run("\n".join(x for pair in zip(left, right) for x in pair)) == 15


def test_rows(spark):
    words12, words11 = ITEM.split()[:12], ITEM.split()[:11]
    data = [(1, "so " + ITEM, "c"), (1, "so " + ITEM, "c"), (2, None, "c"), (3, "", "c"), (4, OTHER, "c"), (5, "pre " + " ".join(words12) + " post", "c"), (6, "pre " + " ".join(words11) + " post", "c"), (7, ("filler text here\n" * 20_000) + ITEM + ("\nmore" * 20_000), "c"), (None, ITEM, "c")]
    items = [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "only three words"), (None, ITEM)]
    df = spark.createDataFrame(data, "doc_id long, text string, words string")
    it = spark.createDataFrame(items, "item_id long, item_text string")
    got = sorted((r.doc_id or 0, r.item_id, r.words) for r in leak.leaks(df, it).collect())
    assert got == sorted([(0, i, 20) for i in (1, 2)] + [(1, i, 20) for i in (1, 2)] * 2 + [(5, i, 12) for i in (1, 2)] + [(7, i, 20) for i in (1, 2)])
    assert leak.leaks(df.limit(0), it).count() == 0 and leak.leaks(df, it.limit(0)).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, f"{OTHER} {ITEM}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, ITEM), *((n, f"{ITEM} {n}") for n in range(10, 30))], "item_id long, item_text string")
    whole = sorted((r.doc_id, r.item_id, r.words) for r in leak.leaks(df, items).collect())
    monkeypatch.setattr(leak, "BLOCK_WORDS", 100)
    assert sorted((r.doc_id, r.item_id, r.words) for r in leak.leaks(df, items).collect()) == whole
    assert len(whole) == 2 * 22 + 2


def test_share_of_short_items(spark):
    df = spark.createDataFrame([(1, "so only three words here"), (2, "three words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "only three words"), (2, ITEM)], "item_id long, item_text string")
    assert leak.leaks(df, items).count() == 0
    assert [(r.doc_id, r.item_id, r.words, r.share) for r in leak.leaks(df, items, min_share=1.0).collect()] == [(1, 1, 3, 1.0)]


def test_other_items_change_nothing():
    """Pages with every third or fourth word misread, and items that have their phrases in common."""
    rng = random.Random(3)
    words = leak.item_words(ITEM)
    others = [" ".join(w if rng.random() < 0.8 else "other" for w in words) for _ in range(60)] + [" ".join(words[k : k + 4]) for k in range(17)] * 4
    for step in (3, 4, 5):
        page = " ".join(w if k % step else w[:-1] + "x" for k, w in enumerate(words))
        known, single = leak.Items([(1, ITEM), *enumerate(others, 2)], 12), leak.Items([(1, ITEM)], 12)
        alone = single.rows_of([page])
        assert alone == [r for r in known.rows_of([page]) if r[1] == 1] and alone[0][2] >= 18
        assert whole(single, page)[0] == whole(known, page)[0] == alone[0][2]


def test_passages_hidden_in_pages(spark):
    """Passages put into pages that hold none, printed with misread letters and broken lines."""
    items = [(r.item_id, r.item_text) for r in spark.read.parquet(f"{SF}/eval_items.parquet").orderBy("item_id").collect()]
    pages = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(200).collect()]
    known = leak.Items(items, 12)
    texts = dict(items)
    rng = random.Random(7)

    def found(page):
        return {i for _, i, _, _ in known.rows_of([page])}

    hits = 0
    for n, page in enumerate(pages):
        item = rng.choice(list(texts))
        words = leak.item_words(texts[item])
        at = rng.randrange(len(words) - 14)
        passage = " ".join(words[at : at + 14])
        for _ in range(2):
            k = rng.randrange(4, len(passage) - 4)
            passage = passage[:k] + {"e": "c", "a": "o", "l": "1", "i": "l"}.get(passage[k], passage[k]) + passage[k + 1 :]
        broken = "\n".join(passage[k : k + 40] + ("-" if passage[k + 40 : k + 41].strip() and passage[k + 39 : k + 40].strip() else "") for k in range(0, len(passage), 40))
        lines = page.split("\n")
        before = found(page)
        new = found("\n".join([*lines[:3], broken, *lines[3:]]))
        hits += item in new
        assert new - before <= {item}
    assert hits >= 0.97 * len(pages)


def test_every_run_is_read(spark):
    """Words that a scan spoils in many ways, against a reading that tries every place of one item."""
    items = [(r.item_id, r.item_text) for r in spark.read.parquet(f"{SF}/eval_items.parquet").orderBy("item_id").limit(60).collect()]
    known, strict = leak.Items(items, 1), leak.Items(items, 12)
    number = {i: n for n, ids in enumerate(known.ids) for i in ids}
    rng = random.Random(11)

    def spoilt(word):
        k = rng.randrange(1, len(word)) if len(word) > 3 else 0
        how = rng.randrange(8)
        if not k or how == 0:
            return word + " "
        if how > 4:
            return word + (" " if how < 7 else "")
        return (word[:k] + " " + word[k:], word[:k] + "-\n" + word[k:], word[:k] + "x" + word[k + 1 :], word + "\nother words\n")[how - 1] + " "

    longest = []
    for _ in range(150):
        item, text = rng.choice(items)
        words = leak.item_words(text)
        at = rng.randrange(len(words) - 13)
        margin = "\nzzzzzzzzzz" * 2 * (leak.JUMP + 1) + "\n"  # keeps the foot from the head
        page = margin + "".join(spoilt(w) for w in words[at : at + 16]) + margin
        got, want = whole(known, page).get(number[item], 0), brute_run(page, text)
        assert got == want, page
        found = [n for _, i, n, _ in strict.rows_of([page]) if i == item]
        assert found == ([want] if want >= 12 and brute_easy(page, text) >= 6 else []), page
        longest.append(got)
    assert sum(n >= 12 for n in longest) > 75


def test_words_cut_at_marks(spark):
    item = "Malnim-on-Weir salue n’arrivent qu’à Nimlet-on-Weir l’été d’un hiver"
    df = spark.createDataFrame([(1, item), (2, item.replace("salue", "salne").replace("hiver", "liver"))], "doc_id long, text string")
    assert sorted((r.doc_id, r.words) for r in leak.leaks(df, spark.createDataFrame([(1, item)], "item_id long, item_text string")).collect()) == [(1, 16), (2, 16)]


def test_wrap_and_advert_in_rows(spark):
    words = ITEM.split()
    head, foot = " ".join(words[6:12]), " ".join(words[:6])
    left = [f"foreign words {i}" for i in range(14)] + [foot]
    right = [head] + [f"other text {i}" for i in range(14)]
    across = "\n".join(f"{a}   {b}" for a, b in zip(left, right))
    turns = "\n".join(x for pair in zip(left, right) for x in pair)
    advert = "\n".join([foot, *["soap and candles of the best make sold here at low prices every day"] * leak.JUMP, head])
    df = spark.createDataFrame([(1, across), (2, turns), (3, advert), (4, advert.replace("soap", "more\nsoap", 1))], "doc_id long, text string")
    got = leak.leaks(df, spark.createDataFrame([(1, ITEM)], "item_id long, item_text string")).collect()
    assert sorted((r.doc_id, r.words) for r in got) == [(1, 12), (2, 12), (3, 12)]


def test_query(spark):
    rows = queries.p7_found(spark, SF).collect()
    assert 0 < len(rows) == len({(r.doc_id, r.item_id) for r in rows})


def test_repetitive_items_and_pages():
    """Items and pages that repeat a phrase cost no more than their length, and are read whole."""
    known = leak.Items([(1, "of the " * 5000), (2, "a"), (3, "of the"), (4, ITEM)], 12)
    assert known.rows_of(["of the " * 3000, "a of the", "x of the " * 2000, f"{ITEM} of the " * 300]) == [(0, 1, 6000, 0.6), (3, 4, 20, 1.0)]
