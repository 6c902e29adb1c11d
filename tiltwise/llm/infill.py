"""Fill-in-middle: a text is cut at two of its unit ends, and its three parts are put in another order behind sentinels.

A pandas UDF takes Arrow batches.  ``finditer`` collects the ends of a text's units (lines, by default) in a compact array, so
two lookups say where to cut.  All that is random comes from a SHA-256 of seed and document id: runs agree, whatever the
partitions, and a lost task draws the same again.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
PARTS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def draws(seed: str, doc_id: str) -> list[int]:
    """The first four groups of eight hex digits of the digest, as numbers."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode("utf-8", "surrogatepass")).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text: str, doc_id: str, unit: regex.Pattern, seed: str, fim_percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the text in its new order."""
    ends = array("Q", (m.end() for m in unit.finditer(text)))
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    # What no unit covers belongs to the unit after it, or to the suffix.
    pre, suf, mid = sentinels
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{suf}{suffix}{pre}{prefix}{mid}{middle}"
    return n, "psm", a, b - a, f"{pre}{prefix}{suf}{suffix}{mid}{middle}"


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text, from the output and its form alone."""
    if form == "plain":
        return output
    pre, suf, mid = sentinels
    one, two = (pre, suf) if form == "psm" else (suf, pre)
    head, middle = output[len(one) :].split(mid, 1)
    head, tail = head.split(two, 1)
    return head + middle + tail if form == "psm" else tail + middle + head


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Refuse sentinels that could be met across the edge of a text: then an output would not say where it was cut."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")


def infill(doc_id: Column, text: Column, unit: str = LINES, seed: str = "7", fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The parts of ``PARTS`` as one struct column."""
    check_sentinels(sentinels)

    def parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        names = [c.split()[0] for c in PARTS.split(", ")]
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts, strict=True):
                n, form, a, m, out = arrange(t, i, pattern, seed, fim_percent, spm_percent, sentinels)
                rows.append((n, form, a, m, out, sha(out), sha(restore(out, form, sentinels))))
            found = pd.DataFrame(rows, columns=names)
            yield found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return F.pandas_udf(parts, PARTS)(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: str = "7", fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256`` for every row of ``docs``.

    ``n`` counts the matches of ``unit``, left to right over code points.  Prefix and middle end after a number of units that
    the digest of ``seed`` and the id draws, from none to all.  A text stays as it is (``plain``, and no counts) if it is
    empty or holds a sentinel, and for ``100 - fim_percent`` of a hundred ids; of the others ``spm_percent`` of a hundred have
    the suffix first.  The text is rebuilt from each output, and ``restored_sha256`` is the digest of that.

    A null text is empty, a null id counts as an empty string, rows that repeat or share an id each have their row (the same
    for equal texts), an empty table stays empty, other columns are ignored.  A text is worked on whole; a task holds a batch
    of 64 MB or one text.
    """
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(doc_id.alias("doc_id"), infill(doc_id, text, unit, seed, fim_percent, spm_percent, sentinels).alias("parts")).select("doc_id", "parts.*")
