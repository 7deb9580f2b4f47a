import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probeloom.llm import mixing, mojibake, queries

SF = "/root/testdata/sf0.01"


def test_tokens_of_long_and_empty_texts(monkeypatch):
    encode = mixing.encoder(mixing.TOKENIZER).encode_ordinary
    text = "In the annals of Gidtor the festival of Selnov is called Nirgev. " * 50
    whole = len(encode(text))
    monkeypatch.setattr(mixing, "PIECE", 256)
    assert mixing.count_tokens(text) == whole
    for text in ("x" * 3000, "ab12" * 700, "a  b\n\n c\t d   " * 200, " " * 900, "dots... and, commas;" * 100, "\x1c a\u3000 b\xa0 c" * 150, "好的，" * 900 + " x" * 200, "it's  we'll \n 12 34" * 90):
        assert mixing.count_tokens(text) == len(encode(text))
    assert mixing.count_tokens("x" * 1000) > 0 and mixing.count_tokens(None) == 0 == mixing.count_tokens("")


def sizes_of(spark, data):
    return spark.createDataFrame(data, "doc_id long, source string, weight double, tokens long")


def test_mix(spark):
    rng = random.Random(4)
    data = [(i, s, rng.choice([0.5, 0.9, 1.0]), rng.randint(20, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 500 + ["small"] * 40 + ["other"] * 100)]
    data += [(9000, "mid", 1.0, 0), (9001, None, 1.0, 50)]
    targets = spark.createDataFrame([("big", 0.4, 3), ("mid", 0.4, 9), ("small", 0.15, 2), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    sizes = sizes_of(spark, data).repartition(5)
    plan = mixing.source_plan(targets, sizes)
    mixed = mixing.mix(sizes, plan)
    got = {r.source: r for r in mixing.shares(plan, mixed).collect()}
    total = sum(t for _, s, _, t in data if s in ("big", "mid", "small"))
    assert {s for s, r in got.items() if not r.reaches} == {"small", "none"}
    for s, share in (("big", 0.4), ("mid", 0.4)):
        assert abs(got[s].mixed - share * total) <= 200  # half a page
    rows = mixed.collect()
    caps = {"big": 3, "mid": 9, "small": 2}
    assert all(1 <= r.repeats <= caps[r.source] for r in rows)
    assert {r.repeats for r in rows if r.source == "small"} == {2} and sum(r.source == "small" for r in rows) == 40
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-9
    assert {(r.doc_id, r.repeats) for r in rows} == {(r.doc_id, r.repeats) for r in mixing.mix(sizes.repartition(3), plan).collect()}
    # surer pages are drawn more often
    used = defaultdict(list)
    chosen = {r.doc_id for r in rows}
    for i, s, w, _ in data:
        if s == "big":
            used[w].append(i in chosen)
    assert np.mean(used[0.5]) < np.mean(used[1.0])


def test_counts_of_a_long_text_without_white_space():
    for text in ("xyz1" * 75_000, "x" * 300_000 + " y"):
        assert mixing.count_tokens(text) == len(mixing.encoder(mixing.TOKENIZER).encode_ordinary(text))


def test_unreached_shares_are_those_of_all_pages(spark):
    """Sources found by what the mix reaches, against the sums."""
    sf_rows = spark.read.parquet(f"{SF}/mix_targets.parquet").collect()
    rows = {r.source: r for r in queries.p8_shares(spark, SF).collect()}
    total = sum(r.available for r in rows.values())
    want = {t.source for t in sf_rows if t.max_repeats * rows[t.source].available < t.target_share * total}
    assert {r.source for r in queries.p8_found(spark, SF).collect()} == want != set()


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    empty = sizes_of(spark, [])
    plan = mixing.source_plan(targets, empty)
    assert mixing.mix(empty, plan).count() == 0
    assert [(r.mixed, r.share, r.reaches) for r in mixing.shares(plan, mixing.mix(empty, plan)).collect()] == [(0, 0.0, True)]  # nothing of nothing
    assert mixing.source_plan(targets.limit(0), empty).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    model = mojibake.train([r.text for r in rows])
    found = mojibake.label([r.text for r in rows], model)
    return model, [r.text for r, spans in zip(rows, found) if not mojibake.garbled_lines(r.text, spans, model)]


@pytest.mark.parametrize("name, written, read", mojibake.PAIRS[:7] + mojibake.PAIRS[10:12] + mojibake.PAIRS[13:14])
def test_garbled_pages_are_restored(pages, name, written, read):
    """Pages garbled on purpose, of those whose characters the encodings can write."""
    model, clean = pages
    hit = total = right = 0
    for page in clean:
        bad = mojibake.garble(page, written, read)
        if "?" in bad.replace("?", "", page.count("?")) or bad == page or (written == "cp1250" and not set(page) & set("łąęśż")):
            continue
        changed = {i for i, (a, b) in enumerate(zip(page.split("\n"), bad.split("\n"))) if a != b}
        found = {n: fixed for n, _, fixed, _ in mojibake.garbled_lines(bad, mojibake.label([bad], model)[0], model)}
        assert found.keys() <= changed
        total += len(changed)
        hit += len(found)
        right += sum(found.get(i) == page.split("\n")[i] for i in changed)
    assert total and hit >= 0.93 * total and right >= 0.85 * total, (hit, right, total)


def test_clean_pages_are_left_alone(pages):
    model, _ = pages
    kept = ["", "plain", "15° proof; £2 the cask\nCHÁ E MAÇÃ, CASA IRMÃ\n120 m³ of dry sand.", "КОЛОКОЛЬНЯ\nКаждый мельник знает, что пристань", "· · ·\n§ ¢ .", "é", "\n\n"]
    assert [mojibake.garbled_lines(t, spans, model) for t, spans in zip(kept, mojibake.label(kept, model))] == [[]] * len(kept)


def test_wrong_decoding_rows(spark, pages):
    model, _ = pages
    data = [(1, "fÃ¼r 2¼ Gulden\nnur so\nKÃ¼ster über MÃ¼hle", "x"), (1, "fÃ¼r 2¼ Gulden\nnur so\nKÃ¼ster über MÃ¼hle", "x"), (2, None, "x"), (3, "", "x"), (4, "ok", "x"), (5, ("lieÃŸ die HÃ¼tte schÃ¶n ausbessern\n" * 3000), "x"), (6, "caf��", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, line_no string")
    got = sorted((r.doc_id, r.line_no, r.restored) for r in mojibake.wrong_decoding(df.drop("line_no").withColumn("pair", F.lit(1)), model).collect())
    assert got[:4] == [(1, 0, "für 2¼ Gulden")] * 2 + [(1, 2, "Küster über Mühle")] * 2
    assert len([g for g in got if g[0] == 5]) == 3000 and got[-1] == (6, 0, "caf��")
    assert mojibake.wrong_decoding(df.limit(0), model).count() == 0


def test_model_survives_pickling(pages):
    import pickle

    model, clean = pages
    copy = pickle.loads(pickle.dumps(model))
    assert mojibake.label(["fÃ¼r KÃ¼ster"], copy) == mojibake.label(["fÃ¼r KÃ¼ster"], model) != [[]]


def test_queries_on_table(spark):
    lines = {(r.doc_id, i): t for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() for i, t in enumerate(r.text.split("\n"))}
    rows = queries.p9_restored(spark, SF).collect()
    assert rows and all(lines[r.doc_id, r.line_no] == r.line and (r.restored != r.line or "�" in r.line) for r in rows)


def test_long_texts_in_pieces(spark, pages, monkeypatch):
    model, _ = pages
    text = "\n".join(["für die alte Hütte", "fÃ¼r die alte HÃ¼tte", "plain"] * 50)
    def found(text):
        held = mojibake._Held(model, "i")
        held.add(1, text)
        return held.rows().to_pydict()

    whole = found(text)
    assert whole["line_no"] == [i for i in range(150) if i % 3 == 1]
    line = found(" ".join(text.split("\n")))
    monkeypatch.setattr(mojibake, "PIECE", 100)
    monkeypatch.setattr(mojibake, "AT_ONCE", 250)
    cut = list(mojibake.pieces(text))
    assert len(cut) > 10 and "".join(t for _, t in cut) == text and all(text[n : n + len(t)] == t for n, t in cut)
    assert found(text) == whole
    # one line longer than a piece is one row, with or without white space
    assert found(" ".join(text.split("\n")))["restored"] == line["restored"] == [" ".join(text.split("\n")).replace("Ã¼", "ü")]
    assert found(text.replace("\n", "").replace(" ", ""))["line_no"] == [0]


def test_memory_of_a_long_page_among_short_ones(pages):
    """One long page does not widen the arrays of the others."""
    import tracemalloc

    model, _ = pages
    texts = ["für die Hütte fÃ¼r"] * 63 + ["fÃ¼r die alte HÃ¼tte " * 13_000]
    assert len(texts[-1]) > 260_000
    model.odds  # the table of the model is there already
    tracemalloc.start()
    held = mojibake._Held(model, "i")
    for n, t in enumerate(texts):
        held.add(n, t)
    rows = held.rows()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.num_rows == 64 and peak < 200e6, peak


def test_planted_lines_are_restored(pages):
    """Restored lines of pages garbled on purpose, in the middle of clean ones, against the truth."""
    model, clean = pages
    rng = random.Random(9)
    right = false = total = 0
    for n, page in enumerate(p for p in clean if not p.isascii()):
        _, written, read = mojibake.PAIRS[rng.randrange(3)]
        lines = page.split("\n")
        bad = [mojibake.garble(x, written, read) if rng.random() < 0.2 else x for x in lines]
        held = mojibake._Held(model, "i")
        held.add(n, "\n".join(bad))
        got = held.rows().to_pydict()
        changed = {i for i, (a, b) in enumerate(zip(lines, bad)) if a != b}
        total += len(changed)
        false += len(set(got["line_no"]) - changed)
        right += sum(lines[i] == fixed for i, fixed in zip(got["line_no"], got["restored"]))
    assert total > 100 and right >= 0.97 * total and false <= 0.02 * total, (right, false, total)


def test_weak_evidence_is_labelled():
    """A text is called clean at once only if no path gains from it."""
    values = np.full((2, len(mojibake.STATES)), -9.0, dtype=np.float32)
    values[:, 0] = 1.1 - mojibake.ENTER[0], -0.1 - mojibake.ENTER[0]
    model = mojibake.Model(np.array([ord("é"), ord("è")]), values, np.full(len(mojibake.STATES), -9.0, dtype=np.float32), {})
    assert mojibake.label(["aéb", "aèb", "ab"], model) == [[(1, 1, 0)], [], []]


def test_sample_takes_pieces_of_long_texts(spark, monkeypatch):
    line = "für die alte Hütte über dem Fluß, schön und groß\n"
    df = spark.createDataFrame([(1, line * 2000), (2, None)], "doc_id long, text string")
    taken = []
    monkeypatch.setattr(mojibake, "train", lambda texts: taken.extend(texts))
    mojibake.fit(df)
    assert len(taken) == 5 and all(len(t) <= mojibake.TRAIN_CHARS for t in taken)
    assert {x for t in taken for x in t.split("\n")} <= {line[:-1], ""}
    with pytest.raises(ValueError):
        mojibake.fit(df, pages=0)


def test_counts_are_those_of_garbled_texts():
    """Observations counted by neighbourhood, against those of every text garbled as a whole."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abZ  .\nÄÖüßéñŁžŐű°·Жяи—“”€😀中Σİ�?") for _ in range(rng.randrange(60))) for _ in range(300)]
    parts = [mojibake._Counts() for _ in range(3)]
    for n, t in enumerate(texts):
        parts[n % 3].add([t])
    whole = mojibake._Counts()
    whole.add(texts)
    whole.garble()
    for k, pair in enumerate([None, *mojibake.PAIRS]):
        want = np.zeros(2 << 16, dtype=np.int64)
        for t in texts:
            np.add.at(want, mojibake.observe(mojibake._codes(mojibake.garble(t, *pair[1:]) if pair else t))[1], 1)
        assert (whole.seen[k] == want).all(), pair
    words = [f" {w} " for t in texts for w in t.lower().split()]
    first = Counter(c for w in words for c in w[:-1])
    want = {p: np.log(n / first[p[0]]) for p, n in Counter(w[i : i + 2] for w in words for i in range(len(w) - 1)).items()}
    got = whole.model().pairs
    assert all(want[p] == pytest.approx(x) for p, x in got.items()) and {p for p in want if "中中" != p and "😀" not in p and "中" not in p} <= got.keys()
    # sums of parts, and parts taken out again, are the same
    table = pa.Table.from_batches([p.rows() for p in parts]).group_by(["kind", "key"]).aggregate([("n", "sum")]).rename_columns(["kind", "key", "n"])
    both = mojibake._Counts.of_rows(table)
    parts[0].add(texts[1::3] + texts[2::3])
    for made, same in [(both, whole), (both.without(parts[1]).without(parts[2]), parts[0].without(parts[1]).without(parts[2]))]:
        assert sorted(made.rows().to_pylist(), key=str) == sorted(same.rows().to_pylist(), key=str)


def test_model_is_that_of_all_pages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    texts = [r.text for r in rows.collect()]
    model, same = mojibake.learn(rows.repartition(5)), mojibake.train(texts)
    assert model.pairs == same.pairs and (model.rows == same.rows).all() and (model.values == same.values).all() and (model.rest == same.rest).all()
    assert mojibake.learn(rows.limit(0)).pairs == {}


def test_letters_of_few_pages_are_learned(spark, tmp_path):
    """Letters that a few pages of many have, in none of those with the smallest hashes, tell a garbled line."""
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("für die alte Hütte über dem Fluß").alias("text"))
    rare = [r.doc_id for r in table.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 12).desc()).limit(41).collect()]
    line = "жук и жаба"
    table = table.withColumn("text", F.when(F.col("doc_id") == rare[0], mojibake.garble(line, "utf-8", "cp1252")).when(F.col("doc_id").isin(rare), line).otherwise(F.col("text")))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.doc_id, r.restored) for r in queries.p9_restored(spark, str(tmp_path)).collect()] == [(rare[0], line)]
