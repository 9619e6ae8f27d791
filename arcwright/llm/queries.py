"""Queries of the operators over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.llm._text import _SPACES
from arcwright.llm import bpe, decontaminate, html_extract, line_dedup, lm_score, minhash, nn_descent, quality, secrets, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(token_counts.sample_edits(docs))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.drop("text").withColumn("kept", (F.col("low_quality") < quality.THRESHOLD) & (F.col("toxicity") < quality.THRESHOLD))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_html": op3_html,
    "op4_decontamination": op4_decontamination,
    "op5_bpe": op5_bpe,
    "op6_secrets": op6_secrets,
    "op7_lm_score": op7_lm_score,
    "op8_quality": op8_quality,
    "op9_minhash": op9_minhash,
    "op10_nn_descent": op10_nn_descent,
}

_WHITE = "||".join(f"chr({c})" for c in _SPACES if c != 10)
_LINES = f"""
with physical as (
  select doc_id, j, l || case when j < n then chr(10) else '' end as l, trim(l, {_WHITE}) as k
  from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as j, len(string_split(text, chr(10))) as n from documents)),
counted as (select *, sum(cast(k <> '' as int)) over (partition by doc_id order by j) as i from physical),
lines as (select doc_id, i, k from counted where k <> ''),
windows as (
  select * from (select doc_id, i, k || chr(10) || lead(k, 1) over w || chr(10) || lead(k, 2) over w as w3 from lines window w as (partition by doc_id order by i)) where w3 is not null),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by w3 order by doc_id, i) as n from windows) where n > 1),
gone as (select distinct doc_id, i + unnest([0, 1, 2]) as i from later),
totals as (
  select c.doc_id, cast(count(*) filter (where g.i is not null and k <> '') as bigint) as removed_lines, coalesce(string_agg(l, '' order by j) filter (where g.i is null), '') as kept
  from counted c left join gone g on g.doc_id = c.doc_id and g.i = greatest(c.i, 1) group by c.doc_id)
"""

SQL: dict[str, str] = {
    "op1_line_dedup": _LINES + """
select d.doc_id, case when coalesce(t.removed_lines, 0) = 0 then d.text else t.kept end as text, coalesce(t.removed_lines, 0) as removed_lines
from documents d left join totals t on t.doc_id = d.doc_id""",
    "op4_decontamination": r"""
with bw as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') as ws from benchmark),
bg as (select distinct item_id, m, list_aggregate(ws[i:i + m - 1], 'string_agg', ' ') as g
  from (select item_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from (select item_id, ws, least(8, len(ws)) as m from bw where len(ws) >= 4))),
dw as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') as ws from documents),
dg as (select doc_id, len(ws) as n, m, i, list_aggregate(ws[i:i + m - 1], 'string_agg', ' ') as g
  from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from dw, (select distinct m from bg) where len(ws) >= m)),
hits as (select doc_id, n, m, i, item_id from dg join bg using (m, g)),
covered as (select doc_id, count(distinct j) as c from (select doc_id, unnest(range(i, i + m)) as j from hits) group by doc_id),
per as (select doc_id, any_value(n) as n, count(distinct m * 10000000 + i) as windows from hits group by doc_id),
named as (select doc_id, string_agg(cast(item_id as varchar), ',' order by item_id) as items from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, cast(windows as bigint) as windows, cast(n as bigint) as words, c / n as share, case when c / n >= 0.5 then 'drop' else 'cut' end as action, items
from per join covered using (doc_id) join named using (doc_id)""",
    "op10_nn_descent": """
with recursive linked as (
  select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id
  where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.9),
reached as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reached r join linked l on l.a = r.b),
least as (select a as vec_id, min(b) as class_id from reached group by a),
counted as (select a as vec_id, count(*) as links from linked group by a)
select vec_id, class_id, coalesce(links, 0) as links from least left join counted using (vec_id)""",
    "op9_minhash": r"""
with recursive words as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') as ws from documents),
sets as (select distinct doc_id, g from (
  select doc_id, unnest(case when len(ws) >= 3 then [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] else [array_to_string(ws, ' ')] end) as g from words where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by all),
near as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= 0.5 * (x.n + y.n - c)),
ways as (select a, b from near union select b, a from near),
reached as (select a, b from ways union select r.a, w.b from reached r join ways w on w.a = r.b),
least as (select a as doc_id, min(b) as kept_id from reached group by a)
select doc_id, kept_id from least where kept_id < doc_id""",
}
