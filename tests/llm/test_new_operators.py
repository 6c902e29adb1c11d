import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from oracle import check
from tiltwise.llm import queries
from tiltwise.llm.infill import LINES, fill_in_middle, restore
from tiltwise.llm.packing import FirstFit, by_words, first_fit_decreasing, pack_documents, pack_group
from tiltwise.llm.phrases import mine_phrases

# Fill in middle -----------------------------------------------------------------------------------------------------------


def brute_infill(doc_id, text, percent=100):
    text = text or ""
    units = re.findall(LINES, text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "x<P>y", "<S\n>", "<", "<\n<S\nP>\n", "é\U0001f600\n中\n" * 7, "\r\n\x0b\x85 \n", "word " * 50_000 + "\n" + "y" * 100_000]


@pytest.mark.parametrize("percent", [100, 40])
def test_infill_equals_brute_force(spark, percent):
    rows = [(None if i % 97 == 5 else i % 150, TEXTS[i % len(TEXTS)], "clash", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    got = fill_in_middle(df, fim_percent=percent).collect()
    want = Counter((i, *brute_infill(i, t, percent)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(hashlib.sha256((t or "").encode()).hexdigest())
    for r in got:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 in texts[r.doc_id]
        assert hashlib.sha256(restore(r.output, r.form).encode()).hexdigest() == r.restored_sha256
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.where("false")).count() == 0


def test_sentinels_that_overlap_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for sentinels in (("<a", "a>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<<P>>", "<M>"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle(df, sentinels=sentinels)


def test_units_of_words(spark):
    text = "one two  three"
    (row,) = fill_in_middle(spark.createDataFrame([(3, text)], "doc_id long, text string"), unit=r"\S+\s*").collect()
    assert row.n == 3 and restore(row.output, row.form) == text


# Packing ------------------------------------------------------------------------------------------------------------------


def public(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_first_fit_by_tree_equals_a_scan():
    rng = random.Random(2)
    for _ in range(50):
        size = rng.choice([8, 64, 100])
        lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(1, 200))])
        bins, room = [], []
        for i in np.argsort(-lengths, kind="stable").tolist():
            at = next((k for k, r in enumerate(room) if r >= lengths[i]), len(bins))
            if at == len(bins):
                bins.append([])
                room.append(size)
            bins[at].append(i)
            room[at] -= lengths[i]
        assert first_fit_decreasing(lengths, size) == bins
    assert FirstFit(8, 1).place(8) == 0


def test_groups_are_packed_without_padding():
    rng = random.Random(3)
    for size in (1, 2, 64):
        for _ in range(100):
            lengths = np.array([rng.randint(1, max(1, size - 1)) for _ in range(rng.randint(1, 80))])
            sequences = pack_group(lengths, size)
            filled = [sum(p[2] for p in s) for s in sequences]
            assert all(f <= size and f & (f - 1) == 0 for f in filled) and sum(f < size for f in filled) <= size.bit_length()
            covered = defaultdict(list)
            for s in sequences:
                for i, start, length in s:
                    assert length > 0
                    covered[i] += range(start, start + length)
            assert [sorted(covered[i]) for i in range(len(lengths))] == [list(range(n)) for n in lengths]


def checked_packing(rows, pieces, size, end_id):
    """All ids once, gapless sequences, no padding; pieces of rows that share an id are matched as multisets."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public())
    want, got = Counter(), defaultdict(list)
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])
        want[i, len(ids)] += len(ids)
        got_ids = np.array(ids, dtype="<u4")
        got[i, len(ids)].append(got_ids)
    seen = Counter()
    for p in pieces:
        seen[p.doc_id, p.doc_tokens] += p.length
        assert len(p.ids) == 4 * p.length and 0 < p.length <= size
        assert any(c[p.start : p.start + p.length].tobytes() == bytes(p.ids) for c in got[p.doc_id, p.doc_tokens])
    assert seen == +want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size and at & (at - 1) == 0
    return sequences


def test_packing_keeps_every_id_once(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta,", "it's", "été", "é", "中文", "12.5", "<|endoftext|>", "Å", "\x1c", "x\x85y", " ", "!!", "\U0001f600", "ẞ", "Σ"]
    texts = [None, "", " ", "\n\t\r"] + [rng.choice([" ", "\n", "\t", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    rows = [(None if i % 40 == 3 else i % 120, t, "clash") for i, t in enumerate(texts)] + [(7, "the same row again", "clash")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    for end_id, groups in ((2, 100_000), (None, 700)):
        pieces = pack_documents(df, by_words(public(), limit=50), end_id=end_id, size=64, group_tokens=groups).collect()
        checked_packing(rows, pieces, 64, end_id)
    assert pack_documents(df.where("false"), by_words(public()), end_id=2).count() == 0
    assert pack_documents(df.where("text = ''"), by_words(public())).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, by_words(public()), size=100)


def test_packing_of_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    pieces = pack_documents(queries.table(spark, sf_dir, "documents"), by_words(public()), end_id=2).collect()
    sequences = checked_packing(rows, pieces, 4096, 2)
    assert sum(sum(n for _, n in s) < 4096 for s in sequences.values()) <= 12
    registered = {(r.doc_id, r.start): r.ids_crc32 for r in queries.op12_packing(spark, sf_dir).collect()}
    starts = {(p.doc_id, p.start): zlib.crc32(bytes(p.ids)) for p in pieces}
    assert registered == starts  # runs agree


def test_long_text_is_encoded_in_parts(spark, monkeypatch):
    from tiltwise.llm import packing

    monkeypatch.setattr(packing, "CHUNK", 1000)
    text = " ".join(random.Random(5).choices(["one", "Two,", "é", "x" * 3000], k=3000))
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public()).encode(text, add_special_tokens=False).ids
    assert by_words(public(), limit=30)()([text, "", text[:500]])[0] == np.array(want, dtype="<u4").tobytes()


# Phrases ------------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, longest, least, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * around[p] < 50 * a or p not in around:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def phrase_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "B", "cé", "d", "e", "É", "x\x00y", "\x1c", "\x85", " ", "f|g"]
    texts = [rng.choice([" ", "\t", "  "]).join(rng.choices(words, weights=[40, 9, 8, 7, 6, 3, 2, 1, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(n)]
    texts = [re.sub(" d ", lambda m: rng.choice([" d ", ". ", "\n", ",", " d! "]), t) for t in texts]
    texts += [None, "", "...", "new york city hall"] + ["new york city"] * 30 + ["a a a a a a a"] * 20
    return [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts]


@pytest.mark.parametrize("longest,least,heavy,per_task", [(3, 10, 200_000, 250_000), (3, 10, 50, 300), (4, 3, 100, 500), (2, 5, 10, 1000)])
def test_phrases_equal_brute_force(spark, longest, least, heavy, per_task):
    rows = phrase_rows(longest)
    df = spark.createDataFrame([(i, t, g, 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, rank int").repartition(5)
    got = mine_phrases(df, longest, least, heavy=heavy, per_task=per_task).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, longest, least)


def test_few_phrases_and_none(spark):
    rows = phrase_rows(9)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = mine_phrases(df, top=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 3, 10, top=3)
    assert mine_phrases(df.where("false")).count() == 0 and mine_phrases(df.where("text = 'new york city hall'")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from tiltwise.llm.phrases import exact_share

    cases = [(10**14 + 7, 10**14 + 8, 10**14 + 9), (3, 7, 11), (10**12, 10**14, 10**12), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", exact_share(1_000_000, F.col("a"), F.col("l"), F.col("r")).alias("score"))
    assert all(x.score == 1_000_000 * x.a * x.a // (x.l * x.r) for x in df.collect())


def test_phrases_equal_sql(spark):
    check(spark, queries.op11_phrases, queries.OP11_SQL, "/root/testdata/sf0.01")
