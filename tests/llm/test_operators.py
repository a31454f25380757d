"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from meshwork.llm import common, debruijn, decontaminate, exact_substrings, langid, licenses, minhash, mixing, quality, suffixes, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "bcdfghklmnprst" for b in ("a", "en", "ion", "or", "ust")]


def prose(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def sample(seed=1):
    rng = random.Random(seed)
    base, long_ = prose(rng, 120), prose(rng, 6000)
    texts = [base, base, prose(rng, 60) + " " + base[:420], prose(rng, 3), "", None, long_, " ".join([prose(rng, 40)] * 3), "a a a a a a", "one"]
    for k in range(20):
        words = base.split()
        for i in rng.sample(range(120), k % 9):
            words[i] = prose(rng, 1)
        texts.append(" ".join(words))
    return [(i, t, "xx", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_minhash_components_equal_brute_force(docs):
    sets = {r[0]: shingles(r[1]) for r in sample()}
    own = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    own[a] = own[b] = min(own[a], own[b])
    got = found(minhash.query(docs))
    assert {i: r["component_id"] for i, r in got.items()} == own
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_minhash_with_one_large_group(spark):
    """Copies that differ in up to a third of their words: many moderately similar pairs, few links."""
    rng = random.Random(4)
    base = [prose(rng, 1) + str(i) for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(12)):
            words[k] = f"w{rng.random()}"
        rows.append((i, " ".join(words), None, None, 0))
    sets = {r[0]: shingles(r[1]) for r in rows}
    own = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in range(a):
                if own[a] != own[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    own[a] = own[b] = min(own[a], own[b])
                    changed = True
    assert {i: r["component_id"] for i, r in found(minhash.query(spark.createDataFrame(rows, SCHEMA))).items()} == own


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    raw = text.tobytes()
    order = suffixes.suffix_array(text, 400)
    assert sorted(range(400), key=lambda i: raw[i:]) == order.tolist()


def without_repeats(rows):
    seen, want = set(), {}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        want[i] = (sum(gone), hashlib.sha256(bytes(b for b, x in zip(raw, gone, strict=True) if not x)).hexdigest())
    return want


def removals(df):
    return {i: (r["n_removed"], r["kept_sha256"]) for i, r in found(df).items()}


def test_exact_substrings_equal_brute_force(docs):
    assert removals(exact_substrings.query(docs)) == without_repeats(sample())


@pytest.mark.parametrize("group", [1, 2000])
def test_exact_substrings_with_a_frequent_anchor(spark, group):
    """A passage in most documents whose surroundings agree over few bytes, so that the groups of its anchors are split."""
    rng = random.Random(5)
    passage, near = prose(rng, 40), [prose(rng, 20) for _ in range(3)]
    rows = []
    for i in range(120):
        left, right = rng.choice(near), rng.choice(near)
        text = prose(rng, 8) + left[rng.randrange(len(left)) :] + passage[: rng.randrange(60, len(passage))] + "é" * (i % 3) + right[: rng.randrange(len(right))] + prose(rng, 8)
        rows.append((i, text, "en", "s", len(text)))
    want = without_repeats(rows)
    assert removals(exact_substrings.dedup(spark.createDataFrame(rows, SCHEMA), group=group)) == want
    assert sum(n for n, _ in want.values()) > 5000


def test_repeated_windows_equal_brute_force(docs):
    words = {r[0]: WORD.findall(r[1] or "") for r in sample()}
    count = {}
    for w in words.values():
        for p in range(len(w) - 34):
            count[tuple(w[p : p + 35])] = count.get(tuple(w[p : p + 35]), 0) + 1
    want = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in found(debruijn.query(docs)).items()} == want


def test_licenses(spark):
    texts = ["Released UNDER the MIT license, under the mit-license.", "Apache License, Version 2 and CC-BY-NC", None, "", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause", "plain words"]
    got = found(licenses.query(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)))
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 1, 5, "mit")
    assert got[1]["base_labels"] == "apache-2,cc-by-nc"
    assert (got[2]["n_words"], got[2]["first_word"], got[3]["labels"], got[3]["score"]) == (0, None, "", 0.0)
    assert got[4]["labels"] == "bsd,gpl,mit" and got[4]["permissive"] and got[5]["score"] == 0


@pytest.mark.parametrize(("text", "rpn", "ok"), [("MIT OR (Apache-2.0 AND BSD)", ["MIT", "Apache-2.0", "BSD", "AND", "OR"], True), ("GPL-2.0 WITH x OR MIT", ["GPL-2.0", "x", "WITH", "MIT", "OR"], True), ("MIT AND", ["MIT"], False), ("", [], False)])
def test_expressions(text, rpn, ok):
    got, good = licenses.parse(text)
    assert ([x.upper() for x in got], good) == ([x.upper() for x in rpn], ok)


def test_quality_counts_and_order(docs):
    got = found(quality.query(docs))
    for i, text, *_ in sample():
        w = WORD.findall(text or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        cover = {k + j for k, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)} if len(w) < 500 else None
        assert got[i]["n_words"] == len(w) and got[i]["word_chars"] == sum(map(len, w))
        assert cover is None or got[i]["n_repeat_words"] == len(cover)
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * got[i]["n_repeat_words"] > 50 * len(w))
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_quality_rules_are_ordered_by_what_is_left():
    rules = [quality.Rule(x, None) for x in "abc"]
    # b alone rejects most a second; what it leaves, c rejects rather than a
    m = quality.Measured({"a": 1.0, "b": 1.0, "c": 2.0}, {frozenset(): 50, frozenset("ab"): 30, frozenset("b"): 5, frozenset("c"): 10, frozenset("a"): 4})
    assert [r.name for r in quality.order_rules(rules, m)] == ["b", "c", "a"]


def test_quality_repeats_without_hashes_agree(docs):
    """What sorting the windows themselves finds equals what sorting hashes finds."""
    from pyspark.sql import functions as F

    rows = docs.withColumn("_q_words", quality.words_of(F.col("text")))
    starts = F.array_distinct(F.flatten(F.transform(quality.repeated_by_words(F.col("_q_words")), lambda p: F.array(p, p + 1, p + 2))))
    both = quality.with_repeated_words(rows).withColumn("x", F.when(F.size("_q_words") > 3, F.size(starts)).otherwise(0))
    assert both.filter("x <> n_repeat_words").count() == 0 and both.filter("x > 0").count() > 3


def test_warc_round_trip(spark):
    rng = random.Random(2)
    big = "é<p>" + prose(rng, 400)
    pages = [(5, "http://a/%\r\nb", big), (2, None, big), (9, "u", big), (1, "v", "short"), (3, "w", "short"), (4, "x", None)]
    got = {r["page_id"]: r for r in warc.query(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2)}
    assert all(got[i]["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() and got[i]["payload_bytes"] == len((h or "").encode()) for i, _, h in pages)
    member = warc.encode_record(1, "http://a/%\r\nb", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
    assert warc.decode_record(next(warc.members(memoryview(member))))["url"] == "http://a/%\r\nb"
    broken = zlib.decompress(member, 31).replace(b"x" * 200, b"y" * 200)
    with pytest.raises(ValueError):
        warc.decode_record(broken)


def test_maximal_segments_equal_brute_force():
    rng = random.Random(7)
    for _ in range(50):
        n = 12
        hits = sorted((i, rng.choice([1.0, 2.0, -1.5])) for i in rng.sample(range(n), 5))
        score = [-0.6] * n
        for i, s in hits:
            score[i] = s
        top = max((sum(score[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        got = toxicity.maximal_segments(score)
        assert all(abs(sum(score[a:b]) - s) < 1e-9 for a, b, s in got)
        assert top <= 0 or abs(max(s for *_, s in got) - top) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    bad = [f"vile{i}" for i in range(20)]
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        if i % 4 == 0:
            words[20:26] = rng.choices(bad, k=6)
        rows.append((i, " ".join(words), None, None, 0))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0)]
    got = found(toxicity.query(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    held = [i for i in range(400) if got[i]["held_out"]]
    assert len(held) > 50 and sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(6)
    item = prose(rng, 80)
    edited = item.replace("ion", "iom", 2)
    rows = [(0, prose(rng, 50) + " " + item + " " + prose(rng, 50)), (1, prose(rng, 50) + " " + edited.upper()), (2, prose(rng, 300)), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = decontaminate.query(docs, spark.createDataFrame([(7, item), (8, "tiny"), (9, None)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 7), (1, 7)]


def test_language_on_held_out_rows(spark):
    rng = random.Random(8)
    kinds = {"aa": ["the", "and", "with", "house", "river"], "bb": ["der", "und", "mit", "haus", "fluss"], "cc": ["le", "et", "avec", "maison", "fleuve"]}
    rows = [(i, " ".join(rng.choices(kinds[k], k=30)), k, None, 0) for i in range(240) for k in [sorted(kinds)[i % 3]]]
    rows += [(900, None, None, None, 0), (901, "12 !", "aa", None, 0)]
    got = found(langid.query(spark.createDataFrame(rows, SCHEMA)))
    assert all(got[i]["lang_pred"] == k for i, _, k, *_ in rows[:240] if got[i]["held_out"])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"


def test_mixing_meets_targets(docs):
    got = found(mixing.query(docs))
    total = sum(r["size"] for r in got.values())
    source = {i: s for i, _, _, s, _ in sample()}
    for s in ("s", None):
        own = [r for i, r in got.items() if source[i] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert all(r["taken"] <= 2 * r["size"] for r in got.values())
    assert abs(sum({r["source_size"]: r["target"] for r in got.values()}.values()) - 1.5 * total) < 1e-6 * total + 1e-6
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in found(mixing.query(docs)).items()}


def test_empty_tables_and_further_columns(spark, none, docs):
    wide = docs.limit(4).selectExpr("*", "1 as key", "2 as id", "3 as size", "4 as spans")
    for f in (licenses.query, quality.query, minhash.query, exact_substrings.query, debruijn.query, langid.query, mixing.query):
        assert f(none).collect() == []
        assert f(wide).count() == 4


def test_pipeline_keeps_one_of_a_group_and_drops_leaks(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    item = prose(rng, 80)
    texts = [prose(rng, 100) for _ in range(6)]
    rows = [(i, t, "xx", "s", len(t)) for i, t in enumerate([*texts, texts[0], texts[1] + " " + item])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in one.collect()} == set(range(6)) | {7}
    assert {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()} == set(range(7))
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert cut[2] == texts[2] and cut[0] == "" and cut[7] == item
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 8


def test_pipeline_links_near_copies_from_080_on(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows = []
    for i in range(0, 40, 2):
        words = [f"w{i}x{k}" for k in range(104)]
        other = list(words)
        for k in (10, 50) if i % 4 else (10, 50, 90):  # 90 or 85 of 110 or 115 shingles in common
            other[k] = f"v{rng.random()}"
        rows += [(i, " ".join(words), None, None, 0), (i + 1, " ".join(other), None, None, 0)]
    sets = {r[0]: shingles(r[1]) for r in rows}
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 40, 2)}
    assert all((0.8 <= s < 0.85) == (i % 4 != 0) for i, s in share.items())
    docs = spark.createDataFrame(rows, SCHEMA)
    want = set(range(40)) - {i + 1 for i, s in share.items() if s >= 0.8}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == want
    assert {r["doc_id"] for r in minhash.keep_first(docs).collect()} == set(range(40))


def test_minhash_with_large_mixed_buckets(spark, monkeypatch):
    """Copies with random subsets of common variants: open members that buckets, once cut, don't bring together."""
    monkeypatch.setattr(minhash, "FULL", 8)
    monkeypatch.setattr(minhash, "GROUPS", 1)  # so that few rows show what cuts miss
    rng = random.Random(12)
    base = [f"w{k}" for k in range(204)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in rng.sample(range(20), rng.randrange(4, 13)):
            words[10 * k + 5] = f"v{k}"
        rows.append((i, " ".join(words), None, None, 0))
    sets = [shingles(r[1]) for r in rows]
    own = list(range(400))
    for a in range(400):
        for b in range(a):
            if own[a] != own[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((own[a], own[b]))
                own = [low if x == high else x for x in own]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert [r["component_rid"] for r in sorted(got.collect(), key=lambda r: r["_rid"])] == own
    assert 20 < len(set(own)) < 380


def test_minhash_plans_stay_small(spark, monkeypatch):
    """The driver holds a plan and what its tasks report until it ends, so long plans are written in steps."""
    seen = []

    def counted(df, name):
        seen.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange "), name))
        return common.materialize(df, name)

    monkeypatch.setattr(minhash, "materialize", counted)
    monkeypatch.setattr(minhash, "FULL", 8)
    rng = random.Random(12)
    rows = []
    for i in range(150):
        words = [f"w{k}" for k in range(204)]
        for k in rng.sample(range(20), rng.randrange(4, 13)):
            words[10 * k + 5] = f"v{k}"
        rows.append((i, " ".join(words), None, None, 0))
    rows += [(200 + i, " ".join(f"w{i // 2}x{k}" for k in range(50 + i % 2)), None, None, 0) for i in range(40)]
    assert minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).filter("_rid >= 200 and component_rid = _rid").count() == 20
    assert {"open", "mixed", "cut", "verified"} <= {name for _, name in seen}
    assert max(seen)[0] <= 12, sorted(seen)[-9:]


def test_freed_native_memory_of_the_driver_is_returned(spark):
    said = common.trim_native_heap(spark)
    if said is None:
        pytest.skip("this JVM has no such command")
    assert said.startswith("Trim native heap: ")
