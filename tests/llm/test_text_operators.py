"""Operators on documents against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tiltwise.llm.common import join_dealt
from tiltwise.llm.decontaminate import MASKS, best_run, drop_overlapping, find_overlaps, item_classes, normal_word
from tiltwise.llm.licenses import GRANTS, KEPT, LOOSE, TEXTS, Scanner, scan_licenses, templates_by_rule, templates_from
from tiltwise.llm.lines import chunks_of, dedup_lines
from tiltwise.llm.minhash import keep_one, near_duplicates, prefixes, signatures, straggler_links, throw
from tiltwise.llm.repeats import anchors_of, joined, pieces_of, remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, home int, n_lines int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstué") for _ in range(rng.randint(2, 9))) for _ in range(n))


# Repeated byte strings ----------------------------------------------------------------------------------------------------


def brute_repeats(rows, depth=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            if raw[i : i + depth] in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(raw[i : i + depth])
        left = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2, "bucket_bytes": 2000}])
def test_repeats_equal_brute_force(spark, options):
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 60)) for _ in range(15)]
    rows = []
    for i in range(80):
        t = ""
        while rng.random() < 0.8:
            s = rng.choice(base)
            a = rng.randrange(len(s))
            t += s[a : a + rng.choice([50, 99, 100, 101, 160, 400])] + rng.choice(["", "x", "\n"])
        rows.append((i, t))
    rows += [(100, "ab" * 300), (101, None), (102, ""), (103, "a" * 100), (104, "a" * 99), (105, "Of " * 200), (None, base[0])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(documents(spark, rows), **options).collect()}
    assert got == brute_repeats(rows)


def test_near_copies_differ_in_what_is_compared():
    """300,000 pairs of texts that differ in one byte: whatever is taken as equal is equal byte by byte.

    Each text has 200 random bytes; the pair's anchors are those of 100-byte windows, and contexts are equal if key and digits are.
    """
    rng = np.random.default_rng(11)
    false, shared = 0, 0
    for _ in range(60):
        a = rng.integers(32, 127, (5000, 200), dtype=np.uint8)
        b, at = a.copy(), rng.integers(0, 200, 5000)
        b[np.arange(5000), at] = 32 + (b[np.arange(5000), at] - 32 + rng.integers(1, 95, 5000)) % 95
        raws = [x.tobytes() for pair in zip(a, b, strict=True) for x in pair]
        for text in pieces_of(raws, 100):
            doc, place, key, around, _ = anchors_of(text, 100)
            order = np.lexsort((place, doc, around, key))
            doc, place, key, around = doc[order], place[order], key[order], around[order]
            for i in np.flatnonzero((key[1:] == key[:-1]) & (around[1:] == around[:-1])).tolist():
                one, two = ((raws[doc[j]], int(place[j])) for j in (i, i + 1))
                contexts = [r[max(0, p - 60) : p + 100] for r, p in (one, two)]
                shared += 1
                false += contexts[0] != contexts[1]
    assert false == 0 and shared > 100_000


def test_many_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(3000):  # pairs that differ in one byte, so that most share an anchor and differ in one digit
        text = bytearray(rng.integers(97, 123, 200, dtype=np.uint8).tobytes())
        rows.append((2 * i, text.decode()))
        text[int(rng.integers(0, 200))] = 33
        rows.append((2 * i + 1, text.decode()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(documents(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_spans_and_long_text(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(3_000_000))  # more than one piece
    rows = [(1, long), (2, "start " + long[1_048_400:1_048_800] + " end")]
    got = {r.doc_id: r for r in remove_repeats(documents(spark, rows)).collect()}
    assert got[1].n_removed == 0
    assert [(s.starts, s.ends) for s in got[2].spans] == [(6, 406)]


def test_repeats_of_many_equal_rows(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(300)) * 2
    rows = [(None, t)] * 500 + [(4, t + "end")] * 300 + [(2, None)] * 3 + [(2**63 - 1, t)] * 2
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(documents(spark, rows)).collect())
    want = {d: v[:2] for d, v in brute_repeats([(4, t + "end"), (None, t)]).items()}
    assert got == Counter({(None, *want[None]): 500, (4, *want[4]): 300, (2, 0, 0): 3, (2**63 - 1, *want[None]): 2})


def test_intervals_are_joined():
    rng = np.random.default_rng(1)
    for _ in range(300):
        low = rng.integers(0, 60, rng.integers(0, 12))
        high = low + rng.integers(-2, 9, len(low))
        covered = {x for a, b in zip(low, high) for x in range(a, b)}
        a, b = joined(low, high)
        assert {x for p, q in zip(a, b) for x in range(p, q)} == covered and (a[1:] > b[:-1]).all()


def test_repeats_of_repeated_rows_and_empty_table(spark):
    t = "x" * 20 + "".join(chr(97 + i % 26) for i in range(7 * 26)) + "yz" * 60
    twice = [(r.n_removed, r.n_spans) for r in remove_repeats(documents(spark, [(1, t), (1, t)])).collect()]
    assert len(twice) == 2 and twice[0] == twice[1] == brute_repeats([(1, t)])[1][1:3]  # one document, given twice
    assert remove_repeats(documents(spark, [])).count() == 0


# Near-duplicates ----------------------------------------------------------------------------------------------------------


def brute_classes(rows, similarity=0.8):
    def cells(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = [cells(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or (both and both >= similarity * either):
                parent[find(i)] = find(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    least = {k: min(v) for k, v in classes.items()}
    return {(d, least[find(i)], len(classes[find(i)])) for i, (d, _) in enumerate(rows)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = prose(rng, rng.randint(30, 200)).split()
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, len(words) // 30, len(words) // 12])):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(1000)
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "one two"), (1004, "one two"), (1005, "one  two"), (1006, "a b " * 300), (1007, "a b " * 299)]
    got = near_duplicates(documents(spark, rows)).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == brute_classes(rows)


def test_near_duplicates_find_links_to_one_member_only(spark):
    """Copies that are near to one document of their group and to no other, whatever the order of ids."""
    rng = random.Random(8)
    rows = []
    for g in range(6):
        words = prose(rng, 230).split()
        group = [words]
        for _ in range(9):
            copy = list(words)
            for at in rng.sample(range(0, 225, 5), 5):  # about 25 of 226 shingles change, so copies are below 0.8 to each other
                copy[at] = f"edit{rng.randrange(10**6)}"
            group.append(copy)
        order = list(range(10))
        rng.shuffle(order)
        rows += [(g * 10 + i, " ".join(group[j])) for i, j in enumerate(order)]
    got = near_duplicates(documents(spark, rows)).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == brute_classes(rows)
    assert {r.class_size for r in got} == {10}


def test_near_duplicates_keep_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "other words"), (2, "x")]
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (None, 1, 3), (None, None, 1), (2, 2, 1)], key=str)
    assert near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2, 3, 256])
def test_stragglers_meet_all_members_of_other_components(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1000, 40)
    sets = {n: sorted({int(x) for x in np.where(rng.random(40) < 0.12, rng.integers(1000, 2000, 40), base)}) for n in range(24)}
    roots = {n: 0 if n % 3 == 0 else 1 if n % 3 == 1 else n for n in sets}
    placed = spark.createDataFrame([(k, n, roots[n]) for k in (1, 2) for n in sets if k == 1 or n < 9], "key long, node long, root long")
    cells = spark.createDataFrame(list(sets.items()), "node long, cells array<long>")
    got = {(r.a, r.b) for r in straggler_links(placed, cells, 0.8, block, 5).collect()}

    def near(a, b):
        both = len(set(sets[a]) & set(sets[b]))
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    true = {(a, b) for a in sets for b in range(a) if roots[a] != roots[b] and near(a, b)}
    assert got <= true and len(true) > 5
    # Every two components with a link are joined by one.
    assert {frozenset((roots[a], roots[b])) for a, b in got} == {frozenset((roots[a], roots[b])) for a, b in true}


def test_signature_agreement_estimates_similarity():
    from tiltwise.llm.common import WordHashes
    from tiltwise.llm.minhash import elements_of, signatures

    words = [f"w{i}" for i in range(400)]
    a, b = elements_of(" ".join(words), WordHashes()), elements_of(" ".join(words[100:]), WordHashes())
    s = signatures([a, b], 2048)
    assert np.isfinite(s).all()
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.04


# Line chunks --------------------------------------------------------------------------------------------------------------


def brute_chunks(lines):
    """First and last line of every chunk, from the rule alone: pairs of lines with no boundary between them, one of which is one."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    hashes = [0] + [xxhash.xxh3_64_intdigest(lines[i].encode()) for i in full]
    marks = [((hashes[n] * 0x9E3779B97F4A7C15 + hashes[n + 1]) % 2**64 >> 29) % 8 != 0 or n in (0, len(full) - 1) for n in range(len(full))]
    for n in range(len(marks)):
        marks[n] = marks[n] or not any(marks[max(0, n - 7) : n])
    pairs = [(i, j) for i in range(len(full)) for j in range(i + 1, len(full)) if (marks[i] or marks[j]) and not any(marks[i + 1 : j])]
    return full, sorted(pairs, key=lambda p: (p[1], p[0]))


def brute_lines(rows):
    """Every chunk is looked for as a list of lines in all that stands before it."""
    split = sorted({(d is None, d or 0, None if t is None else t) for d, t in rows}, key=str)
    places = {}
    for none, d, t in split:
        lines = [] if t is None else t.split("\n")
        full, pairs = brute_chunks(lines)
        for i, j in pairs:
            places.setdefault(tuple(lines[full[i] : full[j] + 1]), set()).add((none, d, t))
    out = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        full, pairs = brute_chunks(lines)
        gone, ends = set(), {}
        for i, j in pairs:
            run = tuple(lines[full[i] : full[j] + 1])
            start, end = full[i] if i else 0, full[j] + 1 if j + 1 < len(full) else len(lines)
            if any(p[:2] < (d is None, d or 0) for p in places[run]) or ends.setdefault(run, end) <= start:
                gone.update(range(start, end))
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def brute_runs(rows):
    """Lines in any run of two or more that are not blank, of any length, that stands before; by document."""
    split = [(d, [] if t is None else t.split("\n")) for d, t in rows]
    out = {}
    for d, mine in split:
        gone = set()
        for i in range(len(mine)):
            for j in range(i + 2, len(mine) + 1):
                run = mine[i:j]
                if sum(1 for x in run if x.strip()) < 2 or not run[0].strip() or not run[-1].strip():
                    continue
                if any(other[k : k + len(run)] == run for e, other in split if other and e < d for k in range(len(other))) or any(mine[k : k + len(run)] == run for k in range(i - len(run) + 1)):
                    gone.update(range(i, j))
        out[d] = gone
    return out


ODD_LINES = [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "\n\n\n\n"), (204, "a\nb\na\nb\na\nb\na\nb"), (205, "q\nq\nq"), (206, "r\nr\nr\nr"), (207, "\nu\n\nv\n"), (208, "\nu\n\nv\n"), (210, "z\n" * 60), (211, "z\n" * 70)]


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    lines = [prose(rng, rng.randint(0, 8)) for _ in range(40)] + [""] * 5
    passage = [prose(rng, 12) for _ in range(9)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, "\n".join([prose(rng, 5), *passage, prose(rng, 5)])) for i in range(5)]
    rows += [*ODD_LINES, (100, rows[60][1]), (5, rows[5][1]), (None, rows[7][1] + "\nown\nlines")]
    got = dedup_lines(documents(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "home", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines(rows)
    assert all(r.n_removed == 9 for r in got.where("doc_id between 101 and 104").collect())  # the shared passage goes whole


def test_lines_of_rows_without_id_or_of_one_id(spark):
    shared = "a first shared line\na second shared line"
    rows = [(None, shared + "\nleft"), (None, shared + "\nright"), (3, "one\n" + shared.replace("shared", "common")), (3, "two\n" + shared.replace("shared", "common"))]
    got = sorted(r.text for r in dedup_lines(documents(spark, rows)).collect())
    assert sum(shared in t for t in got) == 1 and sum("first common" in t for t in got) == 1
    assert sum(t in ("left", "right") for t in got) == 1 and sum(t in ("one", "two") for t in got) == 1


def test_chunk_boundaries_come_back_after_an_insertion():
    rng = random.Random(4)
    lines = [prose(rng, 4) for _ in range(60)]
    before, after = ({c for *_, c in chunks_of("\n".join(x))} for x in (lines, ["new", *lines]))
    assert len(before - after) <= 1


def test_repeated_runs_go_whole(spark):
    """Nothing goes that no run holds, and of the lines in repeated runs nearly all."""
    rng = random.Random(18)
    lines = [prose(rng, rng.randint(1, 4)) for _ in range(25)] + [""] * 5
    rows = [(i, "\n".join(rng.choice(lines[:25]) if n in (0, 5) else rng.choice(lines) for n in range(6))) for i in range(60)]
    passages = [[prose(rng, 6) for _ in range(2 + n % 3)] for n in range(200)]
    rows += [(1000 + 2 * n + k, "\n".join([prose(rng, 6), *p, prose(rng, 6)])) for n, p in enumerate(passages) for k in range(2)]
    rows += [(2000 + 2 * n + k, t) for n, t in enumerate("\n\n".join(prose(rng, 6) for _ in range(10)) for _ in range(20)) for k in range(2)]
    want = brute_runs(rows)
    got = {r.doc_id: r for r in dedup_lines(documents(spark, rows)).collect()}
    wanted = {d: len([i for i in g if t.split("\n")[i].strip()]) for (d, t), g in zip(rows, want.values(), strict=True)}
    cut = {d: sum(1 for x in t.split("\n") if x.strip()) - sum(1 for x in got[d].text.split("\n") if x.strip()) for d, t in rows}
    assert all(cut[d] <= wanted[d] for d in cut)
    assert sum(cut.values()) > 0.97 * sum(wanted.values())
    assert all(got[2001 + 2 * n].text == "" for n in range(20))  # whole copies, blank lines and all


def test_lines_of_an_empty_table(spark):
    assert dedup_lines(documents(spark, [])).count() == 0


# Decontamination ----------------------------------------------------------------------------------------------------------


def test_overlaps_tolerate_substitutions(spark):
    rng = random.Random(6)
    items = [prose(rng, 40) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    rows = [(i, prose(rng, 150)) for i in range(40)]

    def inside(text):
        return prose(rng, 50) + " " + text + " " + prose(rng, 50)

    def changed(text, n):
        w = text.split()
        for i in rng.sample(range(len(w)), n):
            w[i] = "zzz"
        return " ".join(w)

    rows += [(100, inside(items[3])), (101, inside(changed(items[4], 6))), (102, inside(items[5].upper().replace(" ", "!! "))), (103, " ".join(items[6].split()[10:30])), (104, inside(" ".join(items[7].split()[:8])))]
    rows += [(105, None), (106, ""), (107, items[8]), (107, items[8]), (None, items[9])]
    docs = documents(spark, rows)
    got = sorted(((r.doc_id, r.item_id) for r in find_overlaps(docs, bench).collect()), key=str)
    assert got == sorted([(100, 3), (101, 4), (102, 5), (103, 6), (107, 8), (107, 8), (None, 9)], key=str)
    # A table of bits that is much too small only lets more through to the join.
    assert sorted(((r.doc_id, r.item_id) for r in find_overlaps(docs, bench, most_bits=1 << 8).collect()), key=str) == got
    kept = drop_overlapping(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect())) == [*range(40), 104, 105, 106]
    assert find_overlaps(documents(spark, []), bench).count() == 0
    assert find_overlaps(docs, bench.where("false")).count() == 0


def brute_run(same, share=0.75):
    """Most equal tokens of any run that meets the share."""
    runs = ((int(same[i:j].sum()), j - i) for i in range(len(same)) for j in range(i + 1, len(same) + 1))
    return max((m for m, n in runs if m >= share * n), default=0)


def test_best_run_equals_brute_force():
    rng = random.Random(16)
    for _ in range(2000):
        n = rng.randint(0, 24)
        same = np.array([rng.random() < rng.choice((0.6, 0.8)) for _ in range(n)], dtype=bool)
        start, end = best_run(same)
        assert int(same[start:end].sum()) == brute_run(same) and (start == end or (same[start] and same[end - 1]))


def test_overlaps_of_short_items_equal_brute_force(spark):
    rng = random.Random(17)
    items, rows, wanted = [], [], []
    for n in range(300):
        words = [f"w{n}x{i}" for i in range(rng.randint(15, 20))]
        out = {2, 12} if n == 0 else set(rng.sample(range(len(words)), rng.randint(1, 5)))  # n = 0: 13 of 15 or more are equal
        same = np.array([i not in out for i in range(len(words))])
        items.append((n, " ".join(words)))
        rows.append((n, " ".join(["before"] * 20 + [w if s else "zzz" for w, s in zip(words, same, strict=True)] + ["after"] * 20)))
        seeded = any(all(same[p + at] for at in mask) for mask in MASKS for p in range(len(words) - mask[-1]))
        if seeded and brute_run(same) >= 12:
            wanted.append((n, n, brute_run(same)))
    got = find_overlaps(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_matches) for r in got) == wanted and len(wanted) > 200


def brute_overlaps(rows, items, share=0.75, least=12):
    """Document, item and start of every run that meets the rule at an offset where a mask, or a whole short item, agrees."""

    def tokens(t):
        return [w for w in map(normal_word, (t or "").split()) if w]

    found = set()
    shortest = min(m[-1] + 1 for m in MASKS)
    for d, text in rows:
        here = tokens(text)
        for item, content in items:
            own = tokens(content)
            masks = [range(len(own))] if 0 < len(own) < shortest else MASKS if own else []
            for offset in range(-len(own) + 1, len(here)):
                same = np.array([0 <= offset + i < len(here) and here[offset + i] == w for i, w in enumerate(own)], dtype=bool)
                if any(all(same[p + at] for at in m) for m in masks for p in range(len(own) - m[-1])):
                    low, high = max(0, -offset), min(len(own), len(here) - offset)
                    most = brute_run(same[low:high], share)
                    if most >= min(least, -(-3 * len(own) // 4)):
                        found.add((d, item, offset, most))
    return sorted(found, key=str)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(18)
    words = [f"w{i}" for i in range(60)]
    items = [(n, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 7, 8, 9, 11, 14, 25, 40])))) for n in range(30)]
    rows = []
    for n in range(60):
        parts = rng.choices(words, k=rng.randint(0, 40))
        for _ in range(rng.choice([0, 1, 2])):
            own = rng.choice(items)[1].split()
            for i in rng.sample(range(len(own)), len(own) // 6):
                own[i] = "changed"
            parts += own[rng.choice([0, 0, 3]) :] + rng.choices(words, k=rng.randint(0, 5))
        rows.append((n, " ".join(parts)))
    rows += [(100, "Of " * 3000 + items[5][1]), (None, items[8][1]), (2**60 + 1, items[9][1]), (7, items[8][1])]  # long, without id, large id, id of another
    bench = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, doc_id string")
    got = find_overlaps(documents(spark, rows), bench).collect()
    want = brute_overlaps(rows, items)
    assert sorted(((r.doc_id, r.item_id, r.doc_start - r.item_start, r.n_matches) for r in got), key=str) == want
    dirty = {d for d, *_ in brute_overlaps(list(enumerate(t for _, t in rows)), items)}
    kept = drop_overlapping(documents(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted((r for n, r in enumerate(rows) if n not in dirty), key=str) and 5 < len(kept) < 60


def test_items_of_the_same_tokens_are_one(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(5, text), (3, text.upper() + "!"), (4, "a b c d e f g"), (None, "a b  c d e f g"), (9, None)], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_items) for r in find_overlaps(documents(spark, [(1, "so " + text), (2, "a b c d e f g"), (3, "a b c d e f")]), bench).collect()]
    assert sorted(got) == [(1, 3, 2), (2, 4, 2)]
    assert {(r.item_id, r.class_id) for r in item_classes(bench).collect()} == {(5, 3), (3, 3), (4, 4), (None, 4)}


# Licenses -----------------------------------------------------------------------------------------------------------------


def test_licenses_by_wording(spark):
    text = "Some prose.\nLicensed under the Apache License, Version 2.0.\nmore\nThis work is licensed under the GNU General Public License, version 2."
    rows = [(1, text), (2, "Released under the MIT license"), (3, "Licensed under the Apache License, Version 1.1."), (4, "The license fee was paid under protest."), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (8, "Licensed under CC BY 4.0."), (8, "Licensed under CC BY 4.0."), (None, "All rights reserved."), (9, "word " * 30000 + "Released under the MIT License.")]
    got = sorted(((r.doc_id, r.line, r.license) for r in scan_licenses(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, "Apache-2.0"), (1, 3, "GPL-2.0"), (2, 0, "MIT"), (7, 0, "CC-BY-NC-4.0"), (8, 0, "CC-BY-4.0"), (8, 0, "CC-BY-4.0"), (None, 0, "all-rights-reserved"), (9, 0, "MIT")], key=str)
    assert scan_licenses(documents(spark, [])).count() == 0


def test_licenses_wrapped_named_and_several(spark):
    texts = [
        "Prose.\nThis work is licensed under the GNU General\nPublic License, version 3.\nMore.",
        "MIT License", "Apache License, Version 2.0", "Licensed under the Apache License 2.0", "BSD 3-Clause License",
        "# SPDX-License-Identifier: MIT", "SPDX-License-Identifier: (GPL-2.0-or-later OR Apache-2.0)",
        "Licensed under the MIT License. Released under the BSD 3-Clause License.",
        "We compare the MIT License with others.", "Apache License, Version 1.1", "licensed under GPL v3", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007",
        "# Licensed under the Apache License,\n# Version 2.0", "It mentions the GNU Lesser General Public License, version 2.1 and more", "GPLv3 oder MIT, mit Lizenz",
    ]
    got = sorted((r.doc_id, r.line, r.license) for r in scan_licenses(documents(spark, list(enumerate(texts)))).collect())
    assert got == [
        (0, 1, "GPL-3.0"), (1, 0, "MIT"), (2, 0, "Apache-2.0"), (3, 0, "Apache-2.0"), (4, 0, "BSD-3-Clause"), (5, 0, "MIT"), (6, 0, "Apache-2.0"), (6, 0, "GPL-2.0"),
        (7, 0, "BSD-3-Clause"), (7, 0, "MIT"), (10, 0, "GPL-3.0"), (11, 0, "GPL-3.0"), (12, 0, "Apache-2.0"),
    ]


def test_whole_license_texts(spark, tmp_path):
    rng = random.Random(21)
    rows, want = [], []
    for n, (license, text) in enumerate(TEXTS):
        for k, wrapped in enumerate((text, textwrap.fill(text, 60, initial_indent=" * ", subsequent_indent=" * "), textwrap.fill(text.lower(), 40))):
            rows.append((10 * n + k, prose(rng, 30) + "\n\n" + wrapped + "\n\n" + prose(rng, 30)))
            want.append((10 * n + k, 2, license))
    got = sorted((r.doc_id, r.line, r.license) for r in scan_licenses(documents(spark, rows)).collect())
    assert got == sorted(want)
    # Texts from files, however long; a change of some words is told from a change of the license.
    long = " ".join(f"{prose(rng, 8)} section {i}." for i in range(400))
    (tmp_path / "Own-1.0").write_text(long)
    other = " ".join(w if i % 5 else "other" for i, w in enumerate(long.split()))
    near = " ".join(w if i % 50 else "other" for i, w in enumerate(long.split()))
    found = scan_licenses(documents(spark, [(1, "x\n" + textwrap.fill(long, 70)), (2, other), (3, near)]), templates_by_rule() + templates_from(str(tmp_path))).collect()
    assert sorted((r.doc_id, r.line, r.license) for r in found) == [(1, 1, "Own-1.0"), (3, 0, "Own-1.0")]


def plain_notices(template, text):
    """Spans of a short template's notices by its telling words alone: they follow each other, and nothing telling is between."""
    words = [(re.sub(r"(?:\.0)+$", "", m[0]), m.start(), m.end()) for m in re.finditer(r"[a-z]+|\d+(?:\.\d+)*", text.lower())]
    own = [re.sub(r"(?:\.0)+$", "", m) for m in re.findall(r"[a-z]+|\d+(?:\.\d+)*", template.text.lower())]
    matter, telling = [w for w in own if w not in LOOSE], [n for n, w in enumerate(words) if w[0] not in LOOSE]
    found = []
    for k in range(len(telling) - len(matter) + 1):
        at = telling[k : k + len(matter)]
        if [words[n][0] for n in at] != matter:
            continue
        if template.grant and not any(w in GRANTS for w, _, _ in words[max(0, at[0] - 6) : at[0]]):
            continue
        start, end = words[at[0]][1], words[at[-1]][2]
        lines = text[text.rfind("\n", 0, start) + 1 : end + len(text[end:].split("\n")[0])]
        if template.whole and [w for w in re.findall(r"[a-z]+|\d+(?:\.\d+)*", lines.lower()) if w not in LOOSE] != [w for w in re.findall(r"[a-z]+|\d+(?:\.\d+)*", template.text.lower()) if w not in LOOSE]:
            continue
        found.append((start, end))
    return found


def test_notices_equal_a_search_by_words_alone():
    """Without candidates, compression or alignment: what is reported is there, and what is there is reported or overlaps with it."""
    rng = random.Random(22)
    scanner = Scanner(templates_by_rule())
    short = [t for t in scanner.templates if (t.grant or t.whole)]
    sentences = [t.text for t in short]
    checked = 0
    for _ in range(200):
        lines = [rng.choice([prose(rng, 6), rng.choice(sentences), textwrap.fill(rng.choice(sentences), 25), "The license of 2.0 is public.", "version 3", " ".join(rng.sample(sentences, 3))]) for _ in range(rng.randint(1, 5))]
        text = "\n".join(lines)
        want = [(a, b, t.license) for t in short for a, b in plain_notices(t, text)]
        got = [(r[5], r[1]) for r in scanner.scan(text)]
        for start, license in got:
            assert any(a - 60 <= start <= b and own == license for a, b, own in want), (text, start, license)
        for a, b, _ in want:
            assert any(a - 60 <= start <= b for start, _ in got), (text, a, b, got)
        checked += len(want)
    assert checked > 300


def test_each_notice_of_a_long_line_in_little_time(spark):
    import time

    scanner = Scanner(templates_by_rule())
    sentence = "This work is licensed under the GNU General Public License, version 3. "
    for n in (10, 10_000):
        began = time.time()
        found = scanner.scan(sentence * n + "x" * (1_000_000 - 71 * n) if n > 10 else sentence * n)
        assert [r[5] for r in found if r[1] == "GPL-3.0"] == [71 * i for i in range(n)] and len(found) == n
        took = time.time() - began
    assert took < 6  # 1 MB; 2 s on an idle core
    different = " ".join(f"file{i} is licensed under the MIT License." for i in range(3000))
    assert len(scanner.scan(different)) == 3000
    assert scanner.held <= KEPT
    rows = [(r.line, r.license, r.block) for r in scan_licenses(documents(spark, [(1, sentence * 50)])).collect()]
    assert len(rows) == 50 and all(len(b) < 500 for _, _, b in rows)


@pytest.mark.parametrize("split", [1, 7, 10**6])
def test_joins_dealt_over_tasks_equal_plain_ones(spark, split):
    rng = random.Random(23)
    many = spark.createDataFrame([(rng.choice([1, 1, 1, 1, 2, 3, None]), i % 50) for i in range(400)], "k long, a long").repartition(3)
    few = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (4, "w"), (None, "n")], "k long, b string")
    got = join_dealt(many, few, "k", F.col("a"), split)
    assert got.columns == ["k", "a", "b"] and Counter(map(tuple, got.collect())) == Counter(map(tuple, many.join(few, "k").collect()))


def test_overlaps_of_a_passage_in_many_documents(spark, monkeypatch):
    from tiltwise.llm import decontaminate

    rng = random.Random(24)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, 10) + " " + passage + " " + prose(rng, 10)) for i in range(120)] + [(500 + i, prose(rng, 50)) for i in range(30)]
    items = spark.createDataFrame([(1, passage), (2, passage + " and so on"), (3, prose(rng, 20))], "item_id long, text string")
    want = sorted(map(tuple, find_overlaps(documents(spark, rows), items).collect()))
    monkeypatch.setattr(decontaminate, "join_dealt", lambda many, few, key, by, split: join_dealt(many, few, key, by, 5))
    assert sorted(map(tuple, find_overlaps(documents(spark, rows), items).collect())) == want and len(want) == 240


@pytest.mark.parametrize("bin_cells", [100, 1_000_000])
def test_links_do_not_depend_on_how_blocks_are_grouped(spark, bin_cells):
    rng = np.random.default_rng(14)
    base = rng.integers(0, 2**40, 300)
    sets = [np.concatenate([base[:-12], rng.integers(2**41, 2**60, 12)]) for _ in range(12)] + [rng.integers(2**41, 2**60, 3000 if i == 3 else 200) for i in range(8)]
    cells = spark.createDataFrame([(n, s.tolist()) for n, s in enumerate(sets)], "node long, cells array<long>")
    placed = spark.createDataFrame([(5, n, n) for n in range(20)], "key long, node long, root long")
    found = {(r.a, r.b) for r in straggler_links(placed, cells, 0.8, block=3, bin_cells=bin_cells).collect()}
    groups = {n: {n} for n in range(20)}
    for a, b in found:
        merged = groups[a] | groups[b]
        for n in merged:
            groups[n] = merged
    assert {frozenset(g) for g in groups.values()} == {frozenset(range(12)), *(frozenset([n]) for n in range(12, 20))}


def test_near_copies_of_rows_without_id_or_with_the_same_id(spark):
    rng = random.Random(12)
    words = prose(rng, 200).split()
    edits = [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in (20, 90, 150)]
    rows = [(1, edits[0]), (None, edits[1]), (3, edits[2]), (7, prose(rng, 50)), (7, prose(rng, 50)), (None, prose(rng, 40)), (9, edits[0]), (9, edits[0]), (None, edits[1])]
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(documents(spark, rows)).collect())
    assert got == Counter({(1, 1, 6): 1, (None, 1, 6): 2, (3, 1, 6): 1, (9, 1, 6): 2, (7, 7, 1): 2, (None, None, 1): 1})
    kept = keep_one(documents(spark, rows))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, edits[0]), rows[3], rows[4], rows[5]])
    assert keep_one(documents(spark, [])).count() == 0
    same = keep_one(documents(spark, [(None, "one two three")] * 4 + [(4, None), (5, ""), (5, "")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in same if r.text) == [(0, "one two three")] and len(same) == 2


def test_prefixes_find_the_links_of_dense_buckets(spark):
    rng = np.random.default_rng(13)
    template = rng.integers(0, 2**40, 140)  # 70 % of each set, so no two are linked by it alone
    sets = [np.concatenate([template, rng.integers(2**41, 2**60, 60)]) for _ in range(60)]
    for i in range(0, 20, 2):  # ten pairs that differ in a few elements
        sets[i + 1] = np.concatenate([sets[i][:-8], rng.integers(2**41, 2**60, 8)])
    cells = spark.createDataFrame([(n, s.tolist()) for n, s in enumerate(sets)], "node long, cells array<long>")
    placed = spark.createDataFrame([(5, n, n) for n in range(60)], "key long, node long, root long")
    want = {(i + 1, i) for i in range(0, 20, 2)}
    for dense in (0, 10**9):
        links = straggler_links(placed, cells, 0.8, block=4, dense=dense).collect()
        assert {(r.a, r.b) for r in links} == want
    assert prefixes(placed, cells, 0.8).count() < 60 * 20  # the template is in no prefix


def test_components_of_a_long_chain(spark, monkeypatch):
    from tiltwise.llm import components as module

    rounds = []
    stored = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: rounds.append(name) or stored(df, name))
    n = 10_000
    found = module.components(spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")))
    assert found.where("root = 0").count() == found.count() == n
    assert len(rounds) < 22
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 3), (5, 5)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    used = {x for a, b in edges[:-2] if a != b for x in (a, b)}
    got = {r.node: r.root for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in used}


def test_darts_are_thrown_until_no_coordinate_is_bare():
    sets = [np.arange(i + 1, i + 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(0, 8000, 40)]
    few, full = throw(sets, 64, 64 * 2.0), throw(sets, 64, 64 * 16.0)
    assert np.isinf(few).any() and np.isfinite(signatures(sets, 64)).all()
    assert (few[np.isfinite(few)] == full[np.isfinite(few)]).all()  # more darts change nothing that is filled
