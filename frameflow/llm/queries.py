"""Driver queries of the corpus operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.dac import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.search import rank

    return rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.simhash import near_copies

    return near_copies(_table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from frameflow.llm.clustering import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Word n-grams, overlaps of all pairs that share one, and reachability over links.
JACCARD_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as grams from w),
 n as (select doc_id, len(grams) as n from s), e as (select doc_id, unnest(grams) as g from s),
 c as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
 links as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
 both_ways as (select a, b from links union all select b, a from links),
 reach as (select doc_id as d, doc_id as m from n union select l.b, r.m from reach r join both_ways l on l.a = r.d)
 select doc_id, n as n_shingles, component_id from n join (select d, min(m) as component_id from reach group by d) on d = doc_id"""


def oracle_sql() -> dict[str, str]:
    from frameflow.llm.cluster_sql import cluster_sql

    from frameflow.llm.search import SEARCH_SQL

    return {"op3_jaccard_join": JACCARD_SQL, "op11_lexical_search": SEARCH_SQL, "op13_clustering": cluster_sql()}
