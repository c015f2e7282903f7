"""Queries of the training-data problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import byte_bpe, canonical_list, entity_match, history_dedupe, leakage, nonprose, template_residue
from lodestrata.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.find_residue(table(spark, sf_dir, "people")).drop("how")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    aiark, apollo = table(spark, sf_dir, "enrichment_aiark"), table(spark, sf_dir, "apollo_companies")
    sources = [("enrichment_aiark", aiark, "industry", "industry"), ("enrichment_aiark", aiark, "country", "country"), ("apollo_companies", apollo, "industry", "industry")]
    return canonical_list.map_columns(sources, table(spark, sf_dir, "ref_items")).drop("score")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_dedupe.replay(table(spark, sf_dir, "step1_inserts"))


def _matches(spark: SparkSession, sf_dir: str) -> entity_match.Matches:
    return entity_match.match(table(spark, sf_dir, "enrichment_aiark"), table(spark, sf_dir, "salesnav_people"), table(spark, sf_dir, "ref_items"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.matched_pairs(_matches(spark, sf_dir)).drop("confidence")


def p5_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.matched_people(_matches(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nonprose.label_pages(table(spark, sf_dir, "documents")).where("flagged").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_companies": p5_companies, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}
ORACLES: dict[str, str] = {}
