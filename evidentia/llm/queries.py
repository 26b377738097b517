"""Registered queries of the text operators, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cover_tree, infill, licenses, mixing, order_minhash, packing, pages, quality, repeats, simhash, suffix_tree, toxicity, warc
from .common import table


def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.compressed(table(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pages": op1_pages,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_substrings": op7_substrings,
    "op8_mixing": op8_mixing,
    "op9_order_minhash": op9_order_minhash,
    "op10_packing": op10_packing,
    "op11_cover_tree": op11_cover_tree,
    "op12_infill": op12_infill,
    "op13_licenses": op13_licenses,
}
ORACLE = {"op8_mixing": mixing.MIXED_SQL, "op11_cover_tree": cover_tree.oracle(), "op12_infill": infill.FIM_SQL, "op13_licenses": licenses.oracle()}
