"""Each operator and each pipeline stage on empty tables, nulls, repeated rows, very long texts and columns with clashing names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import bpe, common, decontaminate, html_text, imatch, licenses, line_dedup, near_copies, pipeline, simhash, toxicity, url_filter, warc

#: Names that operators use inside.
CLASHING = ["id", "h", "n", "own", "hits", "hit", "stay", "nth", "mark", "node", "comp", "part", "lead", "shard", "doubtful", "gone_lines", "own_id", "label", "at", "size", "maybe", "digest", "first", "fp", "tree", "row"]


def long_text(seed: int, n: int = 60_000) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choices("abcdeéß漢", k=rng.randint(2, 9))) for _ in range(5000)]
    return " ".join(rng.choices(made, k=n))


LONG = long_text(1)
#: Null and repeated ids, null, empty and very long texts, rows that repeat.
ROWS = [(None, "some words of a text"), (None, None), (1, None), (1, ""), (2, LONG), (2, LONG), (3, "x"), (4, "mit license\nmit license"), (4, "mit license\nmit license"), (5, "  \n\t "), (6, LONG + " more")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(i).alias(c) for i, c in enumerate(CLASHING)]
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("doc_id", "text", *extra).repartition(3).cache()


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"words of row {i} " + ("you idiot" if i % 2 else "and more")) for i in range(200)]
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


ITEMS = [(1, "x"), (1, "x"), (2, None), (None, "some words of a text"), (3, "")]


def per_row(name, spark, df, model, vocabulary):
    """A row of the result for each row of df."""
    if name == "op2":
        return imatch.fingerprint_edits(df)
    if name == "op2 by join":
        return imatch.fingerprint_edits(df, lexicon_rows=0)
    if name == "op5":
        return line_dedup.drop_shared_lines(df, least_docs=2)
    if name == "op6":
        return toxicity.score(df, model)
    if name == "op7":
        return simhash.simhash_components(df)
    if name == "near":
        return near_copies.near_components(df)
    if name == "op9":
        return licenses.scan_licenses(df)
    return bpe.round_trip(df, *vocabulary)


@pytest.mark.parametrize("name", ["op2", "op2 by join", "op5", "op6", "op7", "near", "op9", "op10"])
def test_a_row_for_each_row(spark, docs, model, vocabulary, name):
    got = per_row(name, spark, docs, model, vocabulary)
    key = "doc_id" if name == "op5" else "id"
    assert sorted((r[key] for r in got.collect()), key=str) == sorted((i for i, _ in ROWS), key=str)
    nothing = per_row(name, spark, docs.limit(0), model, vocabulary)
    assert nothing.columns == got.columns and nothing.count() == 0


def test_equal_rows_get_equal_results(spark, docs, model, vocabulary):
    for name in ("op6", "op7", "near", "op9", "op10"):
        rows = [tuple(map(str, r)) for r in per_row(name, spark, docs, model, vocabulary).collect()]
        assert len({r for r in rows if r[0] == "2"}) == 1 and len({r for r in rows if r[0] == "4"}) == 1, name


def test_results_of_nulls_and_empty_texts(spark, docs, model, vocabulary):
    prints = {(r.id, r.n_chars): r for r in imatch.fingerprint_edits(docs).collect()}
    assert prints[1, 0].fingerprint == "0" * 256 == prints[None, 0].fingerprint
    lines = line_dedup.drop_shared_lines(docs, least_docs=2)
    assert lines.columns[:-2] == docs.columns
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.collect()}
    # rows of one id are one document: the lines of document 4 are in it alone
    assert (4, "mit license\nmit license", 2, 0) in got and (1, "", 1, 0) in got and (5, "  \n\t ", 2, 0) in got and (2, LONG, 1, 0) in got
    scores = {r.id: r.score for r in toxicity.score(docs.where("text is null or text = ''"), model).collect()}
    assert len(set(scores.values())) == 1
    components = {(r.id, r.component_id) for r in near_copies.near_components(docs).collect()}
    assert {(2, 2), (6, 2), (None, 1), (1, 1), (5, 1)} <= components and (None, None) in components
    assert {(r.id, r.component_id) for r in simhash.simhash_components(docs).collect()} >= {(2, 2), (1, 1), (5, 1), (None, 1)}
    ids = {r.id: r for r in bpe.round_trip(docs, *vocabulary).collect()}
    assert ids[1].n_tokens == 0 and bytes(ids[6].decoded).decode() == LONG + " more"


def test_items_and_documents_that_repeat(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("id", F.lit(0)).withColumn("t", F.lit(1))
    got = sorted(((r.id, r.item_id) for r in decontaminate.find_items(docs, items).collect()), key=str)
    assert got == sorted([(3, 1), (3, 1), (None, None)], key=str)
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 1, 2, 2, 4, 4, 5, 6]  # rows with null ids go together
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.drop_contaminated(docs.limit(0), items).count() == 0


def test_items_in_many_blocks_are_the_same(spark, docs):
    rng = random.Random(5)
    parts = LONG.split()
    items = spark.createDataFrame([(i, " ".join(parts[a : a + 12])) for i, a in enumerate(rng.sample(range(50_000), 30))] + ITEMS, "item_id long, text string")
    one, many = (decontaminate.find_items(docs, items, block_shingles=n) for n in (1_000_000, 40))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and one.count() > 60


def test_pages(spark):
    page = "<article><p>" + "A sentence of the article, rather long. " * 6 + "</p></article>"
    rows = [(None, None, None), (1, "http://a.com/en/x", page), (1, "http://a.com/en/x", page), (2, "http://", ""), (3, "no", page * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c != "url"))
    texts = html_text.extract_text(pages)
    assert sorted(len(r.text) > 0 for r in texts.collect()) == [False, False, True, True, True]
    assert html_text.extract_text(pages.limit(0)).count() == 0
    judged = url_filter.judge(pages, url_filter.rules_frame(spark))
    assert sorted((r.id, r.rule) for r in judged.collect() if r.id) == [(1, "com/en/"), (1, "com/en/"), (2, None), (3, None)]
    assert judged.count() == 5 and url_filter.judge(pages.limit(0), url_filter.rules_frame(spark)).count() == 0
    for some in (pages, pages.limit(0)):
        path = warc.write_archives(some, common.new_table(spark, "w"))
        back = warc.read_archives(spark, path)
        assert back.count() == some.count() and back.where("not sound").count() == 0
    told = sorted((r.page_id, r.type, r.refers_to) for r in warc.read_archives(spark, warc.write_archives(pages, common.new_table(spark, "w"))).collect() if r.page_id)
    assert told == [(1, "response", None), (1, "response", None), (2, "response", None), (3, "response", None)]


def test_hot_payload_and_hot_host(spark):
    """Half of the pages have one payload and one host."""
    rows = [(i, "http://a.com/en/7" if i % 2 else f"http://h{i}.net/de/{i}", "same" if i % 2 else f"page {i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages, common.new_table(spark, "w"))
    back = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert all(back[i].refers_to == (1 if i % 2 and i > 1 else None) for i in range(600))
    judged = url_filter.judge(pages, url_filter.rules_frame(spark), group_rows=50)
    assert {(r.id, r.rule) for r in judged.collect()} == {(i, "com/en/" if i % 2 else "net/de/") for i in range(600)}


def test_hot_line_and_salted_probes(spark, monkeypatch):
    """Half of all lines are one, and a shard's probes are dealt in parts."""
    texts = [f"the same line\nline {i // 12}\nown {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: f"own {i}" if i // 12 < 33 else f"line {i // 12}\nown {i}" for i in range(400)}
    for probes in (line_dedup.PROBES, 50):
        monkeypatch.setattr(line_dedup, "PROBES", probes)
        assert {r.doc_id: r.text for r in line_dedup.drop_shared_lines(df, least_docs=10).collect()} == want
    repeated = df.union(df)  # a document that stands twice is one
    few = df.where("doc_id < 9").union(df.where("doc_id < 9"))
    assert line_dedup.drop_shared_lines(few, least_docs=10).where("n_dropped > 0").count() == 0
    assert {r.doc_id: r.text for r in line_dedup.drop_shared_lines(repeated, least_docs=10).collect()} == want


def test_features_of_texts_beyond_a_slice(monkeypatch):
    text = (LONG + " é漢 ").encode() * 2
    whole = np.sort(np.unique(toxicity.grams(text)))
    for size in (7, 64, 1001):
        monkeypatch.setattr(toxicity, "SLICE", size)
        few = text[:3000].decode("utf-8", "ignore").encode()
        monkeypatch.setattr(toxicity, "SLICE", 1 << 18)
        want = np.sort(toxicity.grams(few))
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert np.array_equal(np.sort(toxicity.grams(few)), want), size
    assert len(whole) > 1000


def test_grams_are_of_code_points():
    def by_force(t):
        clean = " " + " ".join(t.lower().split()) + " "
        return {clean[i : i + n] for n in toxicity.GRAMS for i in range(len(clean) - n + 1)}

    texts = ["idiot", "漢字かな交じり文", "Ünö ß", "a", ""]
    told = {}
    for t in texts:
        own = by_force(t)
        features = toxicity.grams(t.encode())
        assert len(features) == sum(max(0, len(" " + " ".join(t.lower().split()) + " ") - n + 1) for n in toxicity.GRAMS)
        assert len(np.unique(features)) <= len(own)
        told[t] = set(features.tolist())
    assert not told["idiot"] & told["漢字かな交じり文"]


def test_training_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(10)] + [(None, "x")], "doc_id long, text string")
    for labels in ([], [(i, 1) for i in range(10)], [(None, 1), (1, None), (2, 7)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        scores = {r.score for r in toxicity.score(docs, toxicity.train(docs, table)).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert len({r.score for r in toxicity.score(docs, toxicity.train(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).collect()}) == 1
    held = [i for i in range(10) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.id for r in toxicity.score(docs, toxicity.train(docs, table)).where("held_out").collect()} == set(held)


def test_imatch_ties(spark):
    """Equal texts under many ids, and ids that repeat: equal fingerprints, and rows follow one another by their texts."""
    rows = [(i // 3, ["same words here", "same words here", f"other words {i}"][i % 3]) for i in range(60)]
    got = imatch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 60
    same = [r for r in got if r.n_chars == len("same words here")]
    assert len({r.fingerprint for r in same}) == 1 and any(r.near_next == 1.0 for r in same)


def test_a_vocabulary_without_a_byte(vocabulary):
    pairs = bpe.BytePairs({b"a": 0, b"b": 1, b"ab": 2}, r"[\s\S]+")
    assert pairs.encode("abab") == [2, 2]
    with pytest.raises(KeyError):
        pairs.encode("abc")


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_pipeline_stages(spark, docs, k):
    name, stage = pipeline.STAGES[k]
    sf = "/root/testdata/sf0.001"
    assert stage(spark, docs.limit(0), sf).count() == 0
    got = stage(spark, docs, sf)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    if name == "byte_bpe":
        assert len(ids) == len(ROWS)
    else:
        assert got.columns == docs.columns
    if name in ("toxicity", "line_dedup", "benchmark_decontamination"):
        assert len(ids) == len(ROWS)
    if name == "simhash_near_dedup":
        assert sorted(ids, key=str) == sorted([1, 2, 3, 4, None], key=str)
