"""Edge cases of the operators and the pipeline: null and repeated ids, clashing columns, short items, many scripts."""

import random

import numpy as np
import pytest

import corpus_pipeline
from meshwork.llm import debruijn, decontaminate, exact_substrings, langid, licenses, minhash, mixing, quality, toxicity, warc
from meshwork.llm.common import with_row_id
from tests.llm.test_operators import SCHEMA, prose

LABELS = "doc_id long, quality int, toxic int"


def frame(spark, texts, ids=None, lang="xx"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def phrases(sample, text):
    """Longest-match phrases of text, a letter beyond the sample being one of its own."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


@pytest.mark.parametrize("dense", [0, 32])
@pytest.mark.parametrize("piece", [3, 16, 1024])
def test_cross_parsing_equals_brute_force(monkeypatch, dense, piece):
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(dense + piece)
    samples = {f"l{k}": "".join(rng.choices("abcde "[: 3 + k], k=300)) for k in range(3)}
    texts = ["".join(rng.choices("abcdefg ", k=rng.randrange(200))) for _ in range(10)] + ["a" * 90, ""]
    m = langid.Model(samples)
    assert m.dense == bool(dense)
    codes = m.codes_of(langid.code_points("".join(texts)))
    got = m.phrases(codes, np.cumsum([0, *map(len, texts)]))
    assert got.tolist() == [[phrases(samples[x], t) for t in texts] for x in m.languages]


def test_eight_vocabularies_of_many_letters():
    """Two of letters beyond the basic plane, two of Chinese characters without one in common, and four alphabets."""
    rng = random.Random(3)
    starts = {"latin": (0x61, 26), "greek": (0x3B1, 17), "cyrillic": (0x430, 32), "armenian": (0x561, 38), "han-a": (0x4E00, 2500), "han-b": (0x6000, 2500), "plane-2a": (0x20000, 300), "plane-2b": (0x20400, 300)}
    words = {k: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randrange(2, 5))) for _ in range(400)] for k, (a, n) in starts.items()}
    m = langid.Model({k: langid.shared_out([langid.normalised(" ".join(rng.choices(v, k=60))) for _ in range(40)], 20_000) for k, v in words.items()})
    texts = [(k, " ".join(rng.choices(v, k=25))) for k, v in words.items() for _ in range(40)]
    lang, _ = m.predict([t for _, t in texts])
    assert np.mean([a == k for a, (k, _) in zip(lang, texts, strict=True)]) >= 0.99


def test_a_sample_is_shared_evenly():
    assert langid.shared_out(["a" * 1000, "b" * 10, "c" * 1000], 210) == "b" * 10 + " " + "a" * 100 + " " + "c" * 100


def test_short_items_are_found_in_whole_words(spark):
    docs = frame(spark, ["it holds two short words", "it holds two shorter words", "TWO, short!", None, "of a two  short"])
    items = spark.createDataFrame([(1, "two short"), (2, "???"), (3, "two short"), (4, None)], "item_id long, text string")
    got = decontaminate.query(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(d, i) for d in (0, 2, 4) for i in (1, 3)]
    assert {(r["first"], r["end"]) for r in got if r["doc_id"] == 0} == {(9, 18)}


def test_blocks_of_a_benchmark_find_alike(spark):
    rng = random.Random(21)
    items = [prose(rng, 40) for _ in range(6)]
    docs = frame(spark, [prose(rng, 30) + " " + items[k % 6] + " " + prose(rng, 20) for k in range(12)])
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one, many = ({tuple(r) for r in decontaminate.find(docs, table, block=b).collect()} for b in (1 << 22, 300))
    assert one == many and len(one) == 12


def edits(a, b):
    """Fewest edits of a against any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_equals_full_edit_distances(spark):
    rng = random.Random(22)
    items = [prose(rng, n) for n in (4, 6, 12, 18)]
    texts = []
    for k in range(40):
        words = list(items[k % 4])
        for at in rng.sample(range(len(words)), rng.randrange(len(words) // 8 + 2)):
            words[at] = rng.choice(["", "x", words[at] + "y"])
        texts.append(prose(rng, 8) + " " + "".join(words) + " " + prose(rng, 8))
    norm = lambda t: decontaminate.normalise(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tobytes().strip()
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            own = decontaminate.pieces_of(norm(item))
            if any(edits(p, norm(t)) <= decontaminate.budget(len(p)) for _, p in own) or (not own and b" " + norm(item) + b" " in b" " + norm(t) + b" "):
                want.add((d, i))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.query(frame(spark, texts), table).collect()} == want


def test_log_odds_go_either_way():
    words, stems = toxicity.log_odds({b"vile": 9, b"^vile": 9, b"the": 10, b"^the": 10}, {b"the": 90, b"^the": 90, b"kind": 40, b"^kind": 40}, (10, 90))
    assert words[b"vile"] > 2 > 0 > words[b"the"] > words[b"kind"] and words[b"kind"] < -toxicity.DRIFT < words[b"vile"]
    assert abs(words[b"the"] + toxicity.DRIFT) < 0.05 and set(stems) == {b"vile", b"the", b"kind"}


def test_row_ids_are_unique_and_ordered(spark):
    rows = [(None, "b"), (5, "y"), (None, None), (5, "x"), (1, "z"), (None, "b"), (5, "x")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA).repartition(3)
    got = with_row_id(df).orderBy("_rid").collect()
    assert len({r["_rid"] for r in got}) == 7
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert [(r["doc_id"], r["text"]) for r in got] == sorted(rows, key=key)
    assert {r["_rid"] for r in with_row_id(frame(spark, ["a", "b"])).collect()} == {0, 1}


IDS = [None, None, 7, 7, 7, 9, 3, None]


@pytest.mark.parametrize("op", [minhash.query, exact_substrings.query, debruijn.query, licenses.query, quality.query, langid.query, mixing.query])
def test_null_and_repeated_ids(spark, op):
    rng = random.Random(23)
    base = prose(rng, 80)
    texts = [base, prose(rng, 50), base, base, prose(rng, 60), None, "", base]
    got = op(frame(spark, texts, IDS)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((i or 0) for i in IDS)
    if op is minhash.query:
        assert sum(r["kept"] for r in got) == 5
    if op is exact_substrings.query:
        assert sorted(r["n_removed"] for r in got) == [0] * 5 + [len(base)] * 3
    if op is debruijn.query:
        assert sorted(r["n_removed"] for r in got) == [0] * 4 + [80] * 4


def test_clashing_columns_pass_through(spark):
    rng = random.Random(24)
    base = prose(rng, 60)
    docs = frame(spark, [base, base, None]).selectExpr("*", "1 as key", "2 as id", "3 as size", "4 as spans", "5 as rid", "6 as score", "7 as item_id", "8 as taken")
    cols = ("doc_id", "key", "id", "spans", "rid")
    assert debruijn.dedup(docs, keep=cols).select("key", "id", "spans", "rid").distinct().collect() == [(1, 2, 4, 5)]
    assert minhash.keep_first(docs).select("key", "id", "size", "spans", "rid").distinct().collect() == [(1, 2, 3, 4, 5)]
    assert mixing.mix_documents(docs).select("key", "id", "spans", "score").distinct().collect() == [(1, 2, 4, 6)]
    assert exact_substrings.query(docs).count() == 3
    items = spark.createDataFrame([(1, base)], "item_id long, text string")
    assert decontaminate.find(docs, items, keep=("doc_id", "key", "spans")).select("key", "spans").distinct().collect() == [(1, 4)]


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    some = frame(spark, ["a b c", None])
    items = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.query(none, labels).collect() == [] and {r["predicted"] for r in toxicity.query(some, labels).collect()} == {0}
    assert decontaminate.query(none, items).collect() == decontaminate.query(some, items).collect() == []
    assert warc.query(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_mixing_tells_equal_rows_apart(spark):
    rng = random.Random(25)
    docs = frame(spark, [prose(rng, 20)] * 6 + [prose(rng, 15) for _ in range(4)], [1] * 6 + [None] * 4)
    total = sum(r["taken"] for r in mixing.query(docs).collect())
    assert total == sum(r["taken"] for r in mixing.mix_documents(docs).collect()) and total > 0


def test_run_with_nulls_shared_ids_and_labels(spark, tmp_path):
    """The whole pipeline on a table with null and shared ids, repeated rows, empty texts and a clashing column."""
    rng = random.Random(26)
    item = prose(rng, 80)
    clean = [prose(rng, 90) for _ in range(60)]
    bad = [" ".join([*prose(rng, 40).split(), *rng.choices(["vile", "foul", "scum", "trash"], k=8), *prose(rng, 40).split()]) for _ in range(40)]
    rows = [(i, t, 0) for i, t in enumerate(clean)] + [(100 + i, t, 1) for i, t in enumerate(bad)]
    labels = [(i, 1, y) for i, _, y in rows]
    rows += [(None, prose(rng, 50) + " " + item, 0), (7, prose(rng, 40) + " " + item, 0), (None, "", 0), (None, None, 0), (500, clean[3], 0), (500, clean[3], 0), (None, prose(rng, 70), 0)]
    spark.createDataFrame([(i, t, "xx", "s" if k % 2 else None, 0, "x") for k, (i, t, _) in enumerate(rows)], SCHEMA + ", rid string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert left.count() == len(rows) - 2 and left.filter("doc_id = 7").count() == 1
    calm = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert calm.filter("doc_id between 100 and 139").count() <= 2 and calm.filter("doc_id < 60").count() >= 60
    one = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert one.filter("text is null or text = ''").count() == 2 and one.filter("doc_id in (3, 500)").count() == 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["taken"] > 0 and r["text"] and item not in r["text"] for r in out)
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id long, text string"), ("labels", LABELS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_faulty_archives_are_refused():
    import zlib

    html = b"<p>" + b"x" * 300
    digest = __import__("hashlib").sha256(html).hexdigest()
    member = warc.encode_record(1, "u", html, digest, None)
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(memoryview(member[:-9])))
    record = zlib.decompress(member, 31)
    for wrong in (record.replace(b"Content-Length: 3", b"Content-Length: 2"), record[:-10], record + b"x", b"WARC/1.0" + record[8:]):
        with pytest.raises(ValueError):
            warc.decode_record(wrong)
    assert [len(x) for x in warc.members(memoryview(member * 3)) if x] == [len(record)] * 3


@pytest.mark.parametrize("broadcast", [0, 1 << 18])
def test_warc_of_all_sizes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    monkeypatch.setattr(warc, "SMALL", 256)
    monkeypatch.setattr(warc, "ARCHIVE", 1024)
    rng = random.Random(27)
    texts = [None, "", "é" * 99, "a" * 100, "b" * 40_000, *(prose(rng, n) for n in (5, 30, 200, 900))]
    rows = [(k, f"u{k}", texts[k % len(texts)]) for k in range(40)] + [(None, None, "a" * 100), (3, "again", "a" * 100)]
    got = warc.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    first = {t: min(i for i, _, x in rows if x == t and i is not None) for _, _, t in rows if len((t or "").encode()) >= 100}
    want = [(i, len((t or "").encode()), None if i == first.get(t) else first.get(t)) for i, _, t in rows]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
