import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import Row

import corpus_pipeline
from corvane.llm import exact_dedup, near_dedup, quality
from test_dedup import jaccard_groups
from test_text_operators import brute_kept, brute_references


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns and now.select("doc_id").distinct().count() == now.count(), name
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert exact_dedup.exact_groups(now.where("text != ''")).where("not kept").count() == 0
    last = corpus_pipeline.STAGES[4][1](spark, now, sf_dir)
    assert last.select("doc_id").distinct().count() == sizes[4]


def test_near_copies_leave_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = near_dedup.drop_near_duplicates(docs)
    groups = near_dedup.near_duplicates(docs)
    assert kept.count() == groups.select("component_id").distinct().count()


def test_copies_with_null_and_repeated_ids(spark):
    rows = [(None, "alone"), (None, "twice"), (None, "twice"), (None, "named"), (3, "named"), (5, "again"), (5, "again"), (6, "shared"), (6, "own"), (7, "shared"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, more string").repartition(3)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    want = {(None, "alone"), (None, "twice"), (3, "named"), (5, "again"), (6, "own"), (7, "shared"), (9, "")}
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(str(Row(doc_id=i, text=t)) for i, t in want)


def test_copies_without_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (1, "b"), (2, "c"), (2, "d"), (4, "c")], "doc_id long, text string")
    assert sorted(r["text"] + str(r["doc_id"]) for r in exact_dedup.drop_copies(docs).collect()) == ["aNone", "b1", "c4", "d2"]


def test_near_copies_with_null_and_repeated_ids(spark):
    text = lambda k, end="": " ".join(f"w{k}x{i}" for i in range(60)) + end
    rows = [
        (None, text(1)), (None, text(2)), (None, text(2, " more")), (None, text(3)), (3, text(3, " more")), (5, text(5)), (5, text(5)), (5, text(5, " more")),
        (6, text(6)), (7, text(6, " more")), (7, text(7)), (None, ""), (None, ""), (8, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted((str(r["doc_id"]), (r["text"] or "").split("x")[0]) for r in got.collect())
    assert kept == sorted([("None", "w1"), ("None", "w2"), ("3", "w3"), ("5", "w5"), ("6", "w6"), ("7", "w7"), ("None", ""), ("None", ""), ("8", "")])


def corpus():
    """Documents with copies, near copies, shared passages, junk, odd ids, null and empty texts, and repeated rows."""
    r = random.Random(8)
    words = [f"{a}{b}" for a in "bdfgklmn" for b in ("a", "e", "o", "ari", "une", "ost", "ill")]
    text = lambda n: " ".join(r.choices(words, weights=range(len(words), 0, -1), k=n))
    passage = text(70)
    rows = [(k, text(r.randrange(60, 300))) for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(k, rows[k][1]) for k in range(4)]
    rows += [(300 + k, rows[20 + k][1] + " " + text(3)) for k in range(8)]
    rows += [(400 + k, text(90) + "\n" + passage + " " + text(80)) for k in range(6)]
    rows += [(500, "$$ || " * 60), (501, None), (502, ""), (503, " \n"), (504, text(20)), (None, text(100)), (None, None), (None, rows[5][1]), (505, text(9000))]
    r.shuffle(rows)
    return [(i, t, "xx" if k % 9 else None) for k, (i, t) in enumerate(rows)]


@pytest.fixture
def written(spark, tmp_path):
    def make(rows):
        # The extra columns bear names that the stages use inside.
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        df.selectExpr("doc_id", "text", "lang", "'s' AS source", "1L AS n_chars", "'r' AS rid", "2 AS n", "3 AS kept", "'c' AS _content", "'k' AS key", "4 AS spans").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def test_run_like_brute_force(spark, written, monkeypatch):
    rows = corpus()
    path = written(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    ref = brute_references([x[1:] for x in rows])
    assert list(ref) == ["xx"]
    now = [x for x in rows if brute_kept(x[1], x[2], ref, judge_short=True)]
    stage = docs
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:4]):
        stage = f(spark, stage, path)
        assert stage.columns == names, name
        if k == 1:
            best = {}
            for i, t, _ in now:
                best[t] = max(best.get(t, -1), -1 if i is None else i)
            now = [(None if i < 0 else i, t, None) for t, i in best.items()]
        if k == 2:
            now.sort(key=lambda x: (x[0] is None, x[0] or 0))
            group, _ = jaccard_groups([t for _, t, _ in now], 5, 80)
            now = [x for j, x in enumerate(now) if group[j] == j]
        if k == 3:
            now = [(i, t, None) for (i, _, _), t in zip(now, cut([t for _, t, _ in now], 50), strict=True)]
        got = sorted((str(r["doc_id"]), r["text"]) for r in stage.select("doc_id", "text").collect())
        assert got == sorted((str(i), t) for i, t, _ in now), name
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, path).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(str(r["doc_id"]), []).append(r)
    want = {str(i): lib.encode(t, add_special_tokens=False).ids + [1] for i, t, _ in now if i is not None}
    assert set(want) == set(pieces) - {"None"}
    for i, ids in want.items():
        assert [x for r in sorted(pieces[i], key=lambda r: r["start"]) for x in r["ids"]] == ids
    nulls = sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in now if i is None)
    assert sum(r["length"] for r in pieces.get("None", [])) == nulls


def cut(texts, window):
    """Texts without the words of repeated windows, and the white space behind each."""
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    seen = {}
    for ms in found:
        w = [m[0] for m in ms]
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for t, ms in zip(texts, found, strict=True):
        w, gone = [m[0] for m in ms], set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        ends = [m.start() for m in ms[1:]] + [len(t)]
        out.append((t[: ms[0].start()] if ms else t) + "".join(t[m.start() : ends[k]] for k, m in enumerate(ms) if k not in gone))
    return out


def test_run_on_an_empty_table(spark, written):
    assert corpus_pipeline.run(spark, written([])).count() == 0


def test_run_on_odd_rows(spark, written):
    rows = [(1, None, None), (None, None, None), (1, "", "en"), (None, "", "en"), (2, "a", None), (2, "a", None)]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, written(rows)).collect()} == {2}


def test_stages_on_repeated_rows_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(7, text, "en")] * 5 + [(None, text + " more", "en")] * 2, "doc_id long, text string, lang string")
    assert quality.keep_good(docs).count() == 7
    for name, f in corpus_pipeline.STAGES[:4]:
        assert f(spark, docs.limit(0), "").count() == 0, name
    kept = exact_dedup.drop_copies(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "None"]
    assert [r["doc_id"] for r in near_dedup.drop_near_duplicates(kept).collect()] == [7]
