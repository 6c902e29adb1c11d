import inspect
import random

import corpus_pipeline
import pytest
import numpy as np
from oracle import check
from test_text_operators import MASKS, brute_classes, brute_lines, brute_run, normal_word

import __spark_entry__
from tiltwise.llm import queries
from tiltwise.llm.mixing import mix_documents
from tiltwise.llm.quality import score_documents

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name], FOLDER)


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = docs, docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
            assert after.join(before, "doc_id", "left_anti").count() == 0  # no stage makes documents
        counts.append(after.count())
        before = after
    assert counts[0] < docs.count() and counts[1] == counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    run = corpus_pipeline.run(spark, FOLDER)
    assert run.exceptAll(before).count() == 0 and run.count() == counts[4]


def overlaps_any(text, items):
    """Whether a text meets the rule of the decontamination with an item, looked for at every offset."""

    def tokens(t):
        return np.array([w for w in map(normal_word, (t or "").split()) if w], dtype=object)

    here = tokens(text)
    for own in map(tokens, items):
        masks = [range(len(own))] if 0 < len(own) < 8 else MASKS
        for offset in range(-len(own) + 1, len(here)) if len(own) else ():
            low, high = max(0, -offset), min(len(own), len(here) - offset)
            same = np.zeros(len(own), dtype=bool)
            same[low:high] = own[low:high] == here[offset + low : offset + high]
            if same.sum() >= min(6, len(own)) and any(all(same[p + at] for at in m) for m in masks for p in range(len(own) - m[-1])):
                if brute_run(same[low:high]) >= min(12, -(-3 * len(own) // 4)):
                    return True
    return False


def test_pipeline_equals_brute_force(spark):
    """Every stage by plain Python on all documents of the smallest table; scores and the mix have tests of their own."""
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.score for r in score_documents(table, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    rows = {r.doc_id: r for r in table.collect()}
    kept = [(d, r.text) for d, r in rows.items() if scores[d] >= 0.3]
    lines = brute_lines(kept)
    least = {d: c for d, c, _ in brute_classes(lines)}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = [(d, t, rows[d].source) for d, t in lines if least[d] == d and not overlaps_any(t, items)]
    assert len(rows) > len(kept) > len(left) > 50
    want = mix_documents(spark.createDataFrame(left, "doc_id long, text string, source string"), [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken").collect()
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


ODD = "doc_id long, text string, lang string, source string, n_chars long, class_id string, digest int, n_lines string, size double"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "extra", 1, "x", 0.5) for i, t in rows], ODD).repartition(3)


def texts_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def with_word(text, at, word="other"):
    words = text.split()
    return " ".join([*words[:at], word, *words[at + 1 :]])


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_empty_tables_and_clashing_names(spark, stage):
    function = corpus_pipeline.STAGES[stage][1]
    docs = odd(spark, [(1, "one two three\nfour five"), (None, "six seven"), (2, None), (3, "")])
    out, none = function(spark, docs, FOLDER), function(spark, docs.where("false"), FOLDER)
    assert none.count() == 0 and out.count() >= 2
    if stage < 4:
        assert out.columns == none.columns == docs.columns and out.schema["size"].dataType == docs.schema["size"].dataType
        assert {r["class_id"] for r in out.collect()} == {"extra"}


def test_quality_stage_on_odd_rows(spark):
    labelled = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("length(text) > 500").orderBy("doc_id")
    good, junk = (labelled.where(f"quality = {q}").first().text for q in (1, 0))
    big = 10**15
    rows = [(big, good), (big, junk), (None, good), (None, junk), (big + 5, good + "\n" + good * 300), (big + 6, None), (big + 6, None), (big + 7, "")]
    docs = odd(spark, rows).select("doc_id", "text", "class_id").unionByName(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    kept = texts_of(corpus_pipeline.quality(spark, docs, FOLDER).where("class_id = 'extra'"))
    assert (None, good) in kept and (big, good) in kept and not any(t == junk for _, t in kept)
    assert all(r in rows for r in kept) and kept.count((big + 6, None)) in (0, 2)


def test_lines_stage_on_odd_rows(spark):
    run = "first shared line of a passage\nsecond shared line of a passage"
    rows = [(1, "own\n" + run), (2, run + "\nend"), (None, "x\n" + run), (3, None), (4, ""), (9, "only\nhere" * 3)]
    docs = odd(spark, [*rows, (None, "a line that rows have\nwithout any id\nleft"), (None, "a line that rows have\nwithout any id\nright")])
    out = corpus_pipeline.lines(spark, docs, FOLDER)
    got = texts_of(out)
    assert [r for r in got if r[0]] == sorted([(1, "own\n" + run), (2, "end"), (3, None), (4, ""), rows[5]], key=str)
    assert sorted(t for d, t in got if d is None) in (["a line that rows have\nwithout any id\nleft", "right", "x"], ["a line that rows have\nwithout any id\nright", "left", "x"])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_near_copy_stage_on_odd_rows(spark):
    base = prose(1, 200)
    rows = [(7, base), (7, base), (None, with_word(base, 50)), (1, prose(2, 60)), (2, with_word(base, 100)), (2, prose(3, 60)), (None, None), (4, ""), (None, "alone"), (8, prose(4, 30_000))]
    got = texts_of(corpus_pipeline.near_copies(spark, odd(spark, rows), FOLDER))
    assert got == sorted([rows[3], rows[4], rows[5], (4, ""), rows[8], rows[9]], key=str)


def test_leak_stage_on_odd_rows(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    dirty = "before " + item + " after"
    rows = [(1, dirty), (1, "clean words"), (None, dirty), (None, "clean words"), (3, None), (4, ""), (5, dirty), (5, dirty), (6, prose(5, 30_000)), (7, prose(5, 30_000) + " " + dirty)]
    got = texts_of(corpus_pipeline.leaks(spark, odd(spark, rows), FOLDER))
    assert got == sorted([rows[1], rows[3], rows[4], rows[5], rows[8]], key=str)


def test_mix_stage_on_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e"), (None, "d e"), (3, None), (4, ""), (5, "w " * 50_000)]
    got = corpus_pipeline.mix(spark, odd(spark, rows), FOLDER).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 3, 3, 50_000] and {r.source_size for r in got} == {50_010}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got) and abs(sum(r.taken for r in got) - 1.5 * 50_010) < 64
