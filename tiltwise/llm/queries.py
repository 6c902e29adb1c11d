"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_overlaps
from .hamming import nearest_codes
from .htmltext import extract_text
from .infill import fill_in_middle
from .licenses import scan_licenses
from .lines import dedup_lines
from .minhash import near_duplicates
from .mixing import mix_documents
from .packing import by_words, pack_documents
from .phrases import mine_phrases
from .quality import score_documents
from .repeats import remove_repeats
from .urlrules import Rule, judge_urls, rules_frame

URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
WEIGHTS = [5, 2, 1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_documents(table(spark, sf_dir, "documents"), WEIGHTS)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cut.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op10_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_codes(rows, rows.where("vec_id % 50 = 0"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), by_words(public_tokenizers.path("word_bpe_49k.json")), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_minhash, op3_url_rules, op4_quality, op5_html, op6_mix, op7_repeats, op8_licenses, op9_lines, op10_hamming, op11_phrases, op12_packing, op13_infill)
    return {f.__name__: f for f in found}


OP3_SQL = r"""
with split as (
    select page_id,
           translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
    from pages
), rules(rule_host, rule_path, rule_verdict) as (
    values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
    select page_id, host, path, rule_host || rule_path as rule, rule_verdict,
           row_number() over (partition by page_id, host, path order by length(rule_host || rule_path) desc, length(rule_host) desc) as place
    from split join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.rule_verdict, 'allow') as verdict
from split s left join fits f on f.place = 1 and s.page_id is not distinct from f.page_id and s.host = f.host and s.path = f.path
"""


#: Seats are dealt by all quotients here, rather than by the few that are undecided.
OP6_SQL = r"""
with sizes as (
    select doc_id, source, size, digest, count(*) as copies, ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || digest), 1, 15))::bigint as draw
    from (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(text, '')) as digest from documents)
    group by all
), sources as (
    select source, sum(size * copies)::bigint as source_size, sum(copies)::bigint as n_docs from sizes group by source
), weighted as (
    select *, ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as weight from sources
), levels as (
    select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as level from weighted
), reached as (
    select *, row_number() over o as place,
           (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (o rows between current row and unbounded following) as reached
    from levels window o as (order by level, source nulls last)
), common as (
    select arg_min(reached, place) filter (level > reached) as common from reached
), targets as (
    select source, source_size, n_docs, least(cap, coalesce(common * weight, cap)) as target from reached, common
), totals as (
    select round(sum(target) / 32)::bigint as blocks, sum(target) as targets, greatest(16384.0, ceil(sum(source_size + n_docs) / 4096)) as per_shard, count(*) as n from targets
), quotients as (
    select source, (k - 0.5) / (target * blocks / targets) as q, k
    from targets, totals, unnest(generate_series(1, floor(target * blocks / targets)::bigint + n)) as s(k) where target > 0
), dealt as (
    select source, count(*) as seats from (select source, row_number() over (order by q, source nulls last, k) as place from quotients), totals where place <= blocks group by source
), plan as (
    select t.*, coalesce(d.seats, 0) as seats, greatest(1, ceil((t.source_size + t.n_docs) / per_shard))::bigint as n_shards
    from targets t cross join totals left join dealt d on t.source is not distinct from d.source
), spread as (
    select s.*, p.source_size, p.target, p.seats, p.n_shards, least(s.copies, p.n_shards) as ways from sizes s join plan p on s.source is not distinct from p.source
), placed as (
    select * exclude (copies), copies // ways + case when way < copies % ways then 1 else 0 end as copies, (draw + way) % n_shards as shard, draw // n_shards as place
    from spread, unnest(generate_series(0, ways - 1)) as w(way)
), shards as (
    select source, seats, shard, sum(size * copies)::bigint as shard_size, sum(sum(size * copies)) over (partition by source) as own, count(*) over (partition by source) as n from placed group by source, seats, shard
), shard_quotients as (
    select source, shard, (k - 0.5) / (shard_size::double * seats / own) as q, k, seats
    from shards, unnest(generate_series(1, floor(shard_size::double * seats / own)::bigint + n)) as s(k) where shard_size > 0
), shard_seats as (
    select source, shard, count(*) as seats from (
        select *, row_number() over (partition by source order by q, shard, k) as place from shard_quotients) where place <= seats group by source, shard
), blocks as (
    select h.source, h.shard, h.shard_size, greatest(1, round(h.shard_size / 32.0))::bigint as n, least(coalesce(d.seats, 0), 2 * greatest(1, round(h.shard_size / 32.0)))::bigint as quota,
           ('0x' || substr(md5('mix|' || coalesce(h.source, '') || '|' || h.shard::varchar), 1, 15))::bigint as draw
    from shards h left join shard_seats d on h.source is not distinct from d.source and h.shard = d.shard
), spans as (
    select p.*, b.shard_size, b.n, b.quota, b.quota % b.n as rest, b.draw % 2147483647 as first,
           sum(p.size * p.copies) over (partition by p.source, p.shard order by p.place, p.doc_id nulls last, p.size, p.digest, p.way rows unbounded preceding)::bigint - p.size * p.copies as before
    from placed p join blocks b on p.source is not distinct from b.source and p.shard = b.shard
), words as (
    select *, before + copy * size as start, before + (copy + 1) * size as stop from spans, unnest(generate_series(0, copies - 1)) as c(copy)
), chosen as (  -- the block that is taken once more of each stretch of blocks
    select source, shard, low + ((x2 * (x2 % 65519 + 104729)) % 2147483647) % (high - low) as j from (
        select *, (x * (x % 65521 + 7919)) % 2147483647 as x2 from (
            select source, shard, (first + i * 1103515245) % 2147483647 as x, (i * n + rest - 1) // rest as low, ((i + 1) * n + rest - 1) // rest as high
            from (select distinct source, shard, n, rest, first from spans where rest > 0), unnest(generate_series(0, rest - 1)) as s(i)))
), once_more as (
    select source, shard, list(j) as js from chosen group by source, shard
)
select doc_id, size, source_size, target, case when size > 0 then list_sum(list_transform(generate_series(start * n // shard_size, (stop - 1) * n // shard_size),
    lambda j: (quota // n + case when coalesce(list_contains(js, j), false) then 1 else 0 end)
              * greatest(0, least(stop, ((j + 1) * shard_size + n - 1) // n) - greatest(start, (j * shard_size + n - 1) // n))))::bigint else 0 end as taken
from words left join once_more o on words.source is not distinct from o.source and words.shard = o.shard
"""

#: Components at or below 0 are unset bits, so the distance is the number of components whose signs differ.
OP10_SQL = """
with codes as (
    select vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) as bits from embeddings where embedding is not null
), pairs as (
    select q.vec_id as query_id, v.vec_id,
           cast(len(list_filter(list_zip(q.bits, v.bits), lambda p: coalesce(p[1], false) <> coalesce(p[2], false))) as integer) as distance
    from codes q, codes v where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by distance, vec_id nulls last) as integer) as rank, vec_id, distance
from pairs qualify row_number() over (partition by query_id order by distance, vec_id nulls last) <= 10
"""

OP11_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), words as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), phrases as (
    select lang, size, phrase, count(*) as f from (
        select lang, size, unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
        from words, (values (1), (2), (3)) as s(size)
    ) group by all
), candidates as (
    select lang, size, phrase, f as a, string_split(phrase, ' ') as w from phrases where size > 1 and f >= 10
), sides as (
    select lang, phrase, a, 1 as k, w[1] as left_part, array_to_string(w[2:], ' ') as right_part from candidates
    union all select lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] from candidates where size = 3
), cuts as (
    select s.lang, s.phrase, s.a, k, x.f as l, y.f as r, (1000000::hugeint * s.a * s.a) // (x.f::hugeint * y.f) as score
    from sides s join phrases x on x.lang = s.lang and x.phrase = s.left_part join phrases y on y.lang = s.lang and y.phrase = s.right_part
), lowest as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), around as (
    select lang, phrase, max(a) as around from (
        select lang, a, array_to_string(w[1:2], ' ') as phrase from candidates where size = 3 union all select lang, a, array_to_string(w[2:3], ' ') from candidates where size = 3) group by all
), totals as (
    select lang, sum(f)::bigint as n from phrases where size = 1 group by lang
)
select lang, row_number() over o as rank, phrase, a, l, r, n, score::bigint as score from lowest join totals using (lang) left join around using (lang, phrase)
where around is null or 100 * around < 50 * a
window o as (partition by lang order by score desc, a desc, phrase) qualify row_number() over o <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": OP3_SQL, "op6_mix": OP6_SQL, "op10_hamming": OP10_SQL, "op11_phrases": OP11_SQL}
