"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from millrace.llm.bpe import decoded, encode_corpus
from millrace.llm import canonical as C
from millrace.llm.history import match_batches
from millrace.llm.names import company_pairs
from millrace.llm.near_duplicates import likeness_text, near_duplicate_rows
from millrace.llm.packing import fill_report, pack_corpus
from millrace.llm.pieces import split_corpus
from millrace.llm.survivors import FIELDS, survivors
from millrace.operators.packed import KEYS, with_values
from millrace.plans.problems import values_sql
from millrace.plans.reference import WS, _blank
from millrace.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    places, roles = C.place_entries(table(spark, d, "ref_locations")), C.role_entries(table(spark, d, "ref_roles"))
    fields = {"location": (places, C.PLACE_SHORT, C.PLACE_NOISE, True), "role": (roles, C.ROLE_SHORT, C.ROLE_NOISE)}
    return C.canonical_values(table(spark, d, "jobs"), "job_row_id", fields)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "jobs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return company_pairs(table(spark, d, "jobs").select("company"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("job_row_id", likeness_text(F.col("title"), F.col("description")).alias("body"))
    return near_duplicate_rows(jobs, "job_row_id", "body", t=0.6, width=3)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings make the history, then each batch of incoming ones is appended and matched in turn."""
    body = likeness_text(F.col("title"), F.col("description")).alias("body")
    both = None
    for name, batch in (("jobs", F.lit(0)), ("incoming_jobs", F.col("batch_no"))):
        rows = table(spark, d, name).select("job_row_id", batch.alias("batch_no"), "job_id_hash", body, "block_key")
        both = rows if both is None else both.unionAll(rows)
    return match_batches(with_values(both, "block_key", KEYS, "keys"), "job_row_id", t=0.6)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_corpus(table(spark, d, "documents"), "doc_id", "text", _budgets(spark, d))


def _budgets(spark: SparkSession, d: str) -> list[tuple[int, str, int]]:
    return [(r.budget_id, r.tokenizer_name, r.capacity_tokens) for r in table(spark, d, "token_budgets").collect()]


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_corpus(table(spark, d, "documents"), "doc_id", "text", _piece_budgets(spark, d))


def _piece_budgets(spark: SparkSession, d: str) -> list[tuple[int, str, int, int]]:
    return [(r.budget_id, r.tokenizer_name, r.piece_tokens, r.overlap_tokens) for r in table(spark, d, "token_budgets").collect()]


def p8_verified(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as its ids give it back."""
    return decoded(p8_ids(spark, d), "doc_id", "ids").select("doc_id", F.md5("text").alias("text_md5"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers are used for each budget, and how full they are."""
    budgets = _budgets(spark, d)
    return fill_report(pack_corpus(table(spark, d, "documents"), "doc_id", "text", budgets), budgets)


def p9_verified(spark: SparkSession, d: str) -> DataFrame:
    """For each budget: documents placed, containers over the capacity, documents divided that need not be, documents with gaps between their parts."""
    budgets = table(spark, d, "token_budgets").select("budget_id", "capacity_tokens")
    rows = p9_containers(spark, d).join(budgets, "budget_id")
    over = rows.where("container_id >= 0").groupBy("budget_id", "container_id").agg((F.sum("n_tokens") > F.max("capacity_tokens")).alias("over")).groupBy("budget_id").agg(F.count_if(F.col("over")).alias("over_capacity"))
    per = rows.groupBy("budget_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.max("capacity_tokens").alias("c"))
    docs = per.groupBy("budget_id").agg(F.count("*").alias("documents"), F.count_if(F.expr("parts > 1 and n <= c")).alias("divided"), F.count_if(F.expr("n <> `end`")).alias("gaps"))
    return docs.join(over, "budget_id").select("budget_id", "documents", "over_capacity", "divided", "gaps")


def p10_verified(spark: SparkSession, d: str) -> DataFrame:
    """For each budget: pieces over the limit, neighbours that don't share just the overlap, documents over the limit that the pieces don't cover, documents within it that have pieces."""
    limits = table(spark, d, "token_budgets").select("budget_id", "piece_tokens", "overlap_tokens")
    rows = p10_pieces(spark, d).drop("piece_text").join(limits, "budget_id")
    after = F.lead("token_start").over(Window.partitionBy("budget_id", "doc_id").orderBy("piece_no"))
    rows = rows.withColumn("next", after)
    bad = rows.groupBy("budget_id").agg(F.count_if(F.expr("n_tokens > piece_tokens")).alias("too_long"), F.count_if(F.expr("next is not null and token_start + n_tokens - next <> overlap_tokens")).alias("wrong_overlap"))
    size = p8_ids(spark, d).select("doc_id", F.size("ids").alias("size"))
    per = rows.groupBy("budget_id", "doc_id").agg(F.min("token_start").alias("begin"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    whole = size.crossJoin(F.broadcast(limits)).join(per, ["budget_id", "doc_id"], "left")  # a row for each budget, three by the table's definition
    cover = whole.groupBy("budget_id").agg(F.count_if(F.expr("size > piece_tokens and not coalesce(begin = 0 and `end` = size, false)")).alias("uncovered"), F.count_if(F.expr("size <= piece_tokens and begin is not null")).alias("needless"))
    return limits.select("budget_id").join(bad, "budget_id", "left").join(cover, "budget_id", "left").select("budget_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("too_long", "wrong_overlap", "uncovered", "needless")])


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_pieces": p10_pieces, "p8_verified": p8_verified, "p9_fill": p9_fill, "p9_verified": p9_verified, "p10_verified": p10_verified}
_SEEN = "case when last_seen_at >= 1e11 then last_seen_at / 1000 else last_seen_at end"
_BEST = "source_authority desc nulls last, seen desc nulls last, job_row_id"
_BASE = f"select *, lower(trim(canonical_job_id)) as canonical_key, {_SEEN} as seen, len(list_distinct({values_sql('seen_sources', True)})) as n_sources, count(*) over (partition by lower(trim(canonical_job_id))) as n from jobs where trim(canonical_job_id) <> ''"
_P3 = f"with b as ({_BASE}), g as (select * from b where n >= 2) " + " union all ".join(
    f"select canonical_key, '{name}' as field_name, job_row_id from (select canonical_key, job_row_id, row_number() over (partition by canonical_key order by {order}) as k from g where {where}) where k = 1"
    for name, where, order in [("record", "true", _BEST), *[(f, f"not {_blank(f)}", _BEST) for f in FIELDS], ("seen_sources", "n_sources > 0", f"n_sources desc, {_BEST}")]
)



def _alike(rows: str, extra: str, where: str) -> str:
    """Pairs a, b of the rows (job_row_id, body and more) whose sets of three-word runs are alike by 0.6: rare runs meet first, then whole sets are compared."""
    words = f"list_filter(string_split(regexp_replace(trim(regexp_replace(lower(body), '{WS}+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g'), ' '), lambda t: t <> '')"
    runs = "case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end"
    return f"""r as materialized ({rows}), w as materialized (select *, {words} as w from r where body is not null), s as materialized (select *, list_distinct(list_transform({runs}, lambda x: hash(x))) as sh from w where len(w) > 0),
        e as materialized (select job_row_id, len(sh) as n{extra}, unnest(sh) as x from s), f as (select x, count(*) as df from e group by x),
        o as (select e.*, row_number() over (partition by job_row_id order by df, x) as k from e join f using (x)), i as materialized (select * from o where k <= n - ceil(0.6 * n - 1e-9) + 1),
        c as (select distinct a.job_row_id as a, b.job_row_id as b from i a join i b on a.x = b.x and a.job_row_id < b.job_row_id and least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) - 1e-9{where}),
        m as (select a, b, len(list_intersect(p.sh, q.sh)) as m, len(p.sh) + len(q.sh) as n from c join s p on p.job_row_id = a join s q on q.job_row_id = b),
        alike as (select a, b from m where m >= 0.6 * (n - m) - 1e-9)"""


_BODY = f"case when not {_blank('description')} then coalesce(title, '') || ' ' || description end as body"
_P6 = f"with {_alike(f'select job_row_id, {_BODY} from jobs', '', '')} select a as job_row_id_a, b as job_row_id_b from alike"
_ALL = " union all ".join(f"select job_row_id, lower(job_id_hash) as h, {new} as new, {values_sql('block_key', False)} as keys, {_BODY} from {t}" for t, new in (("jobs", "false"), ("incoming_jobs", "true")))
_P7 = f"""with {_alike(_ALL, ', new, keys', ' and (a.new or b.new) and list_has_any(a.keys, b.keys)')} select a as job_row_id_a, b as job_row_id_b from alike
    union select least(a.job_row_id, b.job_row_id), greatest(a.job_row_id, b.job_row_id) from r a join r b on a.h = b.h and a.new and a.job_row_id <> b.job_row_id"""

SQL = {
    "p3_found": _P3, "p6_found": _P6, "p7_found": _P7, "p8_verified": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
    "p9_verified": "select budget_id, (select count(*) from documents) as documents, 0 as over_capacity, 0 as divided, 0 as gaps from token_budgets",
    "p10_verified": "select budget_id, 0 as too_long, 0 as wrong_overlap, 0 as uncovered, 0 as needless from token_budgets",
}
