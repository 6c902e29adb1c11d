import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltwise.llm.hamming import nearest_codes, segments_of
from tiltwise.llm.htmltext import FLOOR, branch_importance, extract_text, kept_text, main_text, read_page
from tiltwise.llm.mixing import div, drawn, mix_documents, seats, source_targets
from tiltwise.llm.quality import STATISTICS, fit, isotonic, keep_quality, score_documents
from tiltwise.llm.urlrules import Rule, judge_urls, rules_frame

# URL rules ----------------------------------------------------------------------------------------------------------------

RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "a.example.net", "/en/x"), Rule("allow", "example.net", "/en/x/y")]


def brute_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


@pytest.mark.parametrize("ranges", [1, 7])
def test_rules_equal_brute_force(spark, ranges):
    rng = random.Random(1)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "example.com", "www.EXAMPLE.com", "m.org", "org", "netx", "", "com"]
    urls = [f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/en/x/y/z', '/de/1', '/fr/', '/en'])}{rng.choice(['', '?q=/en/', '#/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "a://b://example.net/en/", "://net/", "http://net/x\ny"] + ["https://a.example.net/en/x"] * 50
    df = spark.createDataFrame([(i if i % 40 else None, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, range int").repartition(3)
    got = sorted((str(tuple(r)) for r in judge_urls(df, rules_frame(spark, RULES), ranges=ranges).collect()))
    assert got == sorted(str((i if i % 40 else None, *brute_verdict(u))) for i, u in enumerate(urls))


def test_long_urls(spark):
    urls = ["https://" + "a." * 50_000 + "example.net/en/" + "x" * 100_000, "https://example.com/de/" + "?" * 100_000, "x" * 200_000]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules_frame(spark, RULES[:4])).collect()}
    assert got == {i: (brute_verdict_of(u), ("allow", "block", "allow")[i]) for i, u in enumerate(urls)}


def brute_verdict_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    fits = [r for r in RULES[:4] if m and (m[1] == r.host or m[1].endswith("." + r.host)) and m[2].startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return best and best.host + best.path


def test_rules_without_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(df, rules_frame(spark, [])).collect()] == [(1, "a.net", "/", None, "allow")] * 2
    assert judge_urls(df.where("false"), rules_frame(spark, RULES)).count() == 0


# Quality ------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = score_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.97


def test_quality_stage_takes_more_labels_than_it_fits(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    few = keep_quality(docs, labels, max_rows=labels.count() // 2)
    assert few.columns == docs.columns and 0 < few.count() < docs.count()


def test_quality_of_odd_rows(spark):
    rows = [(i, "word salad and more %d" % i if i % 2 else "!! !! !!", "x", i) for i in range(60)]
    rows += [(100, None, None, 0), (101, "", "", 0), (102, "a" * 300_000, "x", 0), (None, "null id", "x", 0), (1, rows[1][1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_documents(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert got[got.doc_id == 1].score.nunique() == 1
    assert got[got.doc_id.between(0, 59)].groupby(got.doc_id % 2).score.mean().is_monotonic_increasing
    assert score_documents(docs, labels.where("false")).toPandas().score.eq(1.0).all()
    assert score_documents(docs.where("false"), labels).count() == 0


def test_fit_equals_one_machine(spark):
    """The normal equations summed by partition give the ridge fit of all rows in one place; isotonic levels as well."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, len(STATISTICS)))
    y = (x[:, 0] + x[:, 3] ** 2 + rng.normal(size=600) * 0.3 > 0.8).astype(int)
    part = rng.integers(0, 4, 600)
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, part)], "x array<double>, y int, part int").repartition(7)
    model = fit(rows, n_features=40)
    own = part < 3
    z = model.features(x)
    assert np.allclose(model.mean, x[own].mean(axis=0)) and np.allclose(model.scale, x[own].std(axis=0))
    # Cosines of projections, to the letter.
    assert np.allclose(z[:, :-1], np.cos((x - model.mean) / model.scale @ model.projection + model.phase) * np.sqrt(2 / 40), atol=1e-9) or (np.abs((x - model.mean) / model.scale) > 6).any()
    ridge = 1e-3 * own.sum() / 40 * np.diag([1.0] * 40 + [0.0]) + 1e-9 * np.eye(41)
    assert np.allclose(model.weights, np.linalg.solve(z[own].T @ z[own] + ridge, z[own].T @ y[own]), atol=1e-6)
    raw = np.round(z[~own] @ model.weights, 3)
    values = np.unique(raw)
    knots, levels = isotonic(values, np.array([y[~own][raw == v].mean() for v in values]), np.array([(raw == v).sum() for v in values], dtype=float))
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.levels, levels, atol=1e-6)


def test_scores_depend_on_texts_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    before = {r.doc_id: r.score for r in score_documents(docs, labels).collect()}
    changed = docs.select("doc_id", "text", F.lit("xx").alias("lang"), F.reverse("source").alias("source"), F.lit(1).alias("quality"))
    held = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    after = {r.doc_id: r.score for r in score_documents(changed, held).collect()}  # labels of held-out rows are turned round
    assert before.keys() == after.keys() and max(abs(before[d] - after[d]) for d in before) < 1e-9
    again = docs.withColumn("doc_id", F.lit(10**16) + F.col("doc_id")).unionByName(docs)
    moved = {r.doc_id: r.score for r in score_documents(again, labels).collect()}
    assert max(abs(moved[d] - moved[10**16 + d]) for d in before) < 1e-12  # an id moves no score


def test_isotonic_is_the_nearest_monotone_fit():
    x, y = np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0])
    at, level = isotonic(x, y, np.ones(6))
    assert (np.diff(level) >= 0).all()
    assert level.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [0.0, 2.5, 5.0]  # equal neighbours are one step


# HTML ---------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav><div id=cookie-notice>We use cookies</div><div class="layout with-sidebar">
<div class="content"><article><h1>T &amp; U</h1><p>One <b>bold</b>&nbsp;word<br>next<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<section class="comments"><article><p>reader</article></section><p>last &lt;x&gt;<!-- no --></article></div><div class=sidebar><p>side</div></div>
<div class="ad">buy</div><form><p>f</form><footer>f</footer></body></html>"""


def test_main_text_of_marked_up_page():
    assert main_text(PAGE) == "T & U\nOne bold word next\na\nb\nc\nd\nlast <x>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &copy; text", "plain © text"), ("a < b <p>unfinished <a hre", "a < b\nunfinished"), ("<p>a<p>b</p></div>c", "a\nb\nc"),
        ('<div class="post"><p>only <i>this</i></div><div class="comments">no</div>', "only this"), ("<p>cut &am", "cut &am"), ("<p> \n\t x \u00a0 y ", "x y"),
        ("<main><p>a</main><p>b", "a"), ("<div style='display: none'>x</div>y", "y"), ("<pre>a\n b</pre>", "a b"), ("<script>if (a<b) {}</script>z", "z"), ("<title>open", ""),
    ],
)
def test_main_text_of_fragments(page, text):
    assert main_text(page) == text


def test_deep_page():
    assert main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"


def test_broken_markup_is_read_in_linear_time():
    pages = ['<a "x ' * 16000, "<p " * 40000, "<a href='x " * 20000, "<b>" * 20000 + "<div>x</div>" * 20000, "<div>" * 20000 + "</x>" * 20000, "<!-- " * 20000, "<" * 100000, "<a b=\"'>" * 20000, "<li><div>" * 20000]
    began = time.time()
    for page in pages:
        main_text(page)
    assert time.time() - began < 9  # each takes some 0.1 s
    assert main_text('<p title="a>b">x</p><p title="y>z') == 'x\nz' and main_text("<!-- a > b -->c<!-- d") == "c"


def brute_importance(pages, shared=8, damping=0.9):
    """The style tree with dictionaries: one of each host, one of all, and the markup's mean."""
    shown, said, marks = {}, {}, {}
    for host, page in pages:
        branches, blocks = read_page(page)
        own = "\n".join(t for b, t in blocks if b.factor > 0.1)
        for b in branches:
            if not b.frame:
                shown.setdefault((host, b.path), {}).setdefault(frozenset(b.below), set()).add(own)
                for t in b.texts:
                    said.setdefault((host, b.path), {}).setdefault(t, set()).add(own)
                marks.setdefault((host, b.path), []).append((b.factor, b.main))
    out = {}
    for tree in ("host", "all"):
        counts, styles = {}, {}
        for (host, path), texts in said.items():
            own = counts.setdefault((host if tree == "host" else "", path), Counter())
            for t, p in texts.items():
                own[t] += len(p)
        for (host, path), sets in shown.items():
            own = styles.setdefault((host if tree == "host" else "", path), Counter())
            for f, p in sets.items():
                own[f] += len(p)
        for (host, path), c in styles.items():
            n = sum(c.values())
            varied = -sum(x / n * np.log(x / n) for x in c.values()) / np.log(n) if n > 1 else 0.0
            top = bottom = 0.0
            for (h, below), texts in counts.items():
                if h == host and (below + "/").startswith(path + "/"):
                    m, weight = sum(styles[h, below].values()), damping ** (below.count("/") - path.count("/"))
                    bottom += weight * sum(texts.values())
                    top += weight * sum(x * (1 - (np.log(x) / np.log(m) if m > 1 else 0)) for x in texts.values())
            if bottom:
                out[tree, host, path] = ((1 - damping) * varied + damping * top / bottom, n)
    result = {}
    for (tree, host, path), (entropy, n) in out.items():
        if tree == "host":
            common, m = out["all", "", path]
            weight = min(m - 1, shared)
            mixed = ((n - 1) * entropy + weight * common + 1) / (n + weight)
            factor, main = np.mean(marks[host, path], axis=0)
            result[host, path] = factor * max(mixed, FLOOR if main > 0.5 else 0)
    return result


def site(rng, n, host, article):
    """Pages with a frame that repeats, a list of links, adverts that differ, and their own text, in an article or not."""
    out = []
    for i in range(n):
        own = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{t}</p>" for t in own)
        share = '<div class="tools"><p>Print this page</p></div>'  # no word that speaks against it
        main = f"<article><h1>{own[0][:20]}</h1>{body}{share}</article>" if article else f'<div class="story"><h1>{own[0][:20]}</h1>{body}{share}</div>'
        links = "".join(f'<li><a href="/{rng.random()}">{rng.choice("uvwxyz") * rng.randint(2, 5)}</a></li>' for _ in range(6))
        advert = '<div class="advert"><p>' + " ".join(rng.choice(["buy", "now", "cheap", "best"]) for _ in range(8)) + "</p></div>"
        page = f'<body><div class="top"><p>Welcome to the site</p></div><div class="list"><ul>{links}</ul></div>{advert}{main}<div class="bottom"><p>All about us</p></div></body>'
        out.append((f"http://{host}/{i}", page, "\n".join([own[0][:20].strip(), *own])))
    return out


def test_style_tree_equals_brute_force(spark):
    rng = random.Random(1)
    pages = [(h, p) for h, n, article in (("a.test", 12, True), ("b.test", 9, False), ("c.test", 1, False), ("d.test", 2, True)) for _, p, _ in site(rng, n, h, article)]
    pages += [("b.test", pages[13][1]), ("", ""), ("", None), ("b.test", "<p>odd <a href=x>page</a>")]
    got = {(r.host, r.path): r.importance for r in branch_importance(spark.createDataFrame(pages, "host string, html string").repartition(3)).collect()}
    want = brute_importance(pages)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("article", [True, False])
def test_style_tree_cuts_the_frame_of_a_site(spark, article):
    rng = random.Random(2)
    pages = [(i, *p, "clash") for i, p in enumerate(site(rng, 40, "site.test", article))]
    pages += [(100 + i, *p, "clash") for i, p in enumerate(site(rng, 3, "small.test", article))]
    copies = site(rng, 1, "copies.test", article)[0]
    pages += [(200 + i, f"{copies[0]}?page={i}", copies[1], copies[2], "clash") for i in range(20)]
    pages += [(300, "http://one.test/1", "<p>Welcome</p>", "Welcome", "x"), (301, None, None, "", None), (302, "none", "", "", ""), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, want string, host string")
    found = extract_text(df).collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in found}
    assert len(found) == len(pages) and extract_text(df.where("false")).count() == 0
    assert all(got[i] == (u, w, len(w)) for i, u, _, w, _ in pages)  # small sites are judged by the shared tree
    assert all(r.n_cut >= 5 for r in found if r.page_id < 100)  # top, list, advert, tools, bottom


def test_the_tree_alone_cuts_neutral_boxes_of_an_article(spark):
    """Boxes whose names say nothing, inside of articles: the markup keeps them, what repeats on the site cuts them."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    offer = " ".join(word() for _ in range(8))
    long = "x" * 250
    pages = []
    for i in range(160):
        own = [" ".join(word() for _ in range(12)) for _ in range(3)]
        body = f'<article><h1>{own[0]}</h1><div class="part1">Offers of the day</div><p>{own[1]}</p><div class="part2">{offer}</div><div class="{long}a"><p>{own[2]}</p></div><div class="{long}b">Call us at any time</div></article>'
        pages.append((i, f"https://site.example/{i}", f"<html><body>{body}</body></html>", own))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    found = {r.page_id: r for r in extract_text(df).collect()}
    assert all(found[i].text == "\n".join(own) and found[i].n_cut == 2 for i, _, _, own in pages)
    assert all("Offers of the day" in main_text(page) and "Call us" in main_text(page) for _, _, page, _ in pages)


def test_articles_of_the_test_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    cut = extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("n_cut >= 3").count()
    assert cut == len(rows)  # links, advert and footer: named so, and beside an article, so no entropy would keep them
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


# Mixing -------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark):
    rng = random.Random(2)
    rows = []
    for s, n in (("hot", 200), ("b", 40), ("é", 40), (None, 30), ("tiny", 2), ("zero", 3)):
        rows += [(len(rows) + i, "" if s == "zero" else "  ".join(["w\u00a0x"] * rng.randint(0, 900)) + "\t", s, "clash", 1) for i in range(n)]
    rows += [(1000, None, "hot", "", 0), (1000, None, "hot", "", 0), (None, "a b c", "hot", "", 0), (1001, "w " * 60_000, "hot", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, size long").repartition(4)
    got = mix_documents(docs, [5, 2, 1]).toPandas()
    assert len(got) == len(rows)
    size = {s: 0 for s in {r[2] for r in rows}}
    for r in rows:
        size[r[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(size, [5, 2, 1], 1.5, 2)
    for s, part in got.groupby(got.source.fillna("<null>")):
        s = None if s == "<null>" else s
        assert (part.source_size == size[s]).all() and part.target.iloc[0] == pytest.approx(want[s])
        assert abs(part.taken.sum() - want[s]) <= 0.01 * want[s] + 32
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    again = mix_documents(docs.repartition(2), [5, 2, 1]).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mix_documents(docs.where("false"), [5, 2, 1]).count() == 0
    assert mix_documents(docs.where("source = 'zero'"), [5, 2, 1]).toPandas().taken.tolist() == [0, 0, 0]


def test_seats_are_sainte_lague(spark):
    rng = random.Random(3)
    for total in (0, 1, 7, 100, 997):
        votes = [rng.choice([0, 1, 3, 50, 1000]) * rng.random() for _ in range(9)]
        df = spark.createDataFrame([("g", i, v, total) for i, v in enumerate(votes)], "g string, party int, votes double, total long")
        got = {r.party: r.seats for r in seats(df, ["g"], ["party"], "votes", "total").collect()}
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v > 0 for k in range(total)))[:total]
        assert got == {i: sum(1 for _, j in quotients if j == i) for i in range(9)}


def test_targets_without_cap(spark):
    df = spark.createDataFrame([("a", 10, 2), ("b", 10, 1), (None, 10, 1)], "source string, size long, copies long")
    got = {r.source: r.target for r in source_targets(df, [1, 1, 1], 1.5, 2).collect()}
    assert got == {"a": 15.0, "b": 15.0, None: 15.0}


def test_equal_rows_are_spread_over_shards(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same text " * 4).alias("text"), F.lit("s").alias("source"))
    got = mix_documents(docs.unionByName(docs.limit(7).withColumn("text", F.lit("other"))), [1], share=0.75).toPandas()
    assert len(got) == 20_007 and got.shard.nunique() == len(range(0, 20_007 + 400_007, 16_384))  # documents and words
    assert got.shard.value_counts().max() < 1.2 * len(got) / got.shard.nunique()
    assert abs(got.taken.sum() - 0.75 * 400_007) < 0.002 * 300_000 and (got.taken <= 2 * got["size"]).all()


def test_blocks_of_a_shard_are_chosen_at_random(spark):
    """Each stretch gives one block, and which one is no progression."""
    docs = spark.range(512).select("id", F.lit("w " * 32).alias("text"), F.lit("s").alias("source"))
    got = mix_documents(docs, [1], share=0.25, shard_words=10**6, id_col="id").toPandas()
    assert got.shard.nunique() == 1 and set(got.taken) <= set(range(33)) and got.taken.sum() == 0.25 * 512 * 32
    chosen = spark.range(2000).select(F.pmod(drawn(F.lit(12345), F.col("id")), F.lit(8)).alias("at"), F.pmod(drawn(F.lit(54321), F.col("id")), F.lit(8)).alias("other")).toPandas()
    assert chosen["at"].value_counts().between(200, 300).all() and (chosen["at"] == chosen.other).mean() < 0.2
    assert chosen["at"].diff().value_counts(normalize=True).max() < 0.2


def test_whole_division_of_large_numbers(spark):
    a, b = 9_007_199_254_740_993 * 7 + 3, 7
    assert spark.range(1).select(div(F.lit(a), F.lit(b))).first()[0] == a // b


# Hamming search -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims", [40, 64, 100, 5])
def test_nearest_equal_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(6, dims))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=dims) * 0.5]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (501, []), (502, [None] * dims), (503, [1.0] * 3), (0, rows[0][1]), (None, rows[1][1]), (None, rows[50][1]), (2**60 + 1, rows[2][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, part int, q int").repartition(3)
    queries = df.where("vec_id % 50 = 0 or vec_id is null or vec_id > 1000")
    found = nearest_codes(df, queries, k=10, split=20).collect()  # most values of short segments are split
    got = {(r.query_id, r.rank): (r.vec_id, r.distance) for r in found}

    def bits(v):
        return np.array([x is not None and x > 0 for x in v] + [False] * (dims - len(v)))

    codes = [(i is None, i, bits(v)) for i, v in rows if v is not None]
    asked = [r for r in rows if (r[0] is None or r[0] % 50 == 0 or r[0] > 1000) and r[1] is not None]
    assert len(found) == 10 * len(asked)
    for q, v in asked:
        best = sorted((int((bits(v) != c).sum()), none, i or 0) for none, i, c in codes)[:10]
        if q is not None and q != 0:
            assert [got[q, n + 1] for n in range(10)] == [(None if none else i, d) for d, none, i in best]


def test_segments_cover_all_bits_once():
    for dims, n in ((1, 1), (5, 3), (64, 10_000), (64, 10**9), (100, 500), (1024, 10**6)):
        bits = [(word, low + i) for word, low, width in segments_of(dims, n) for i in range(width)]
        assert sorted(set(bits)) == sorted(bits) == [(i // 64, i % 64) for i in range(dims)]


def test_nearest_with_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.distance) for r in nearest_codes(df, df.where("vec_id = 1")).orderBy("rank").collect()] == [(1, 1, 0), (1, 2, 1)]
    assert nearest_codes(df.where("false"), df.where("false")).count() == nearest_codes(df, df.where("false")).count() == nearest_codes(df.where("false"), df).count() == 0
