"""Context tables from nested publication records: one flat table for each relation, dated to the month after publication.

A record has id, publication_date, type, language, authorships (author, position, institutions), referenced_works,
primary_location (source) and topics. Malformed dates give null dates, so their facts fall in no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkloom.functions.columns import null_marks, one_hot

#: The shape and the codes of publication records.
SCHEMA = (
    "id string, title string, publication_date string, type string, language string, "
    "authorships array<struct<author_position: string, author: struct<id: string, display_name: string>, institutions: array<struct<id: string, display_name: string>>>>, "
    "referenced_works array<string>, "
    "primary_location struct<source: struct<id: string, display_name: string, type: string, is_oa: boolean, is_in_doaj: boolean>, is_oa: boolean>, "
    "topics array<struct<id: string, display_name: string, score: double>>"
)
WORK_TYPES = ["article", "book-chapter", "preprint", "dataset", "review"]
POSITIONS = ["first", "middle", "last"]
SOURCE_TYPES = ["journal", "repository", "conference", "ebook platform", "book series"]


def dated(records: DataFrame) -> DataFrame:
    return records.withColumn("date", F.trunc(F.add_months(F.try_to_date("publication_date"), 1), "month")).withColumnRenamed("id", "work_id")


def basic(works: DataFrame) -> DataFrame:
    return works.select("work_id", "date", *one_hot("type", WORK_TYPES), *one_hot("language", ["en"]))


def citations(works: DataFrame) -> DataFrame:
    return works.select("work_id", F.explode("referenced_works").alias("cited_work_id"), "date").where("work_id is not null and cited_work_id is not null").distinct()


def _authorships(works: DataFrame) -> DataFrame:
    return works.select("work_id", "date", F.explode("authorships").alias("a")).select("work_id", "date", F.col("a.author.id").alias("author_id"), F.col("a.author_position").alias("author_position"), F.col("a.institutions").alias("institutions"))


def authors(works: DataFrame) -> DataFrame:
    marks = [F.max(F.when(F.col("author_position") == p, 1).otherwise(0)).alias(f"author_position_is_{p}") for p in POSITIONS]
    return _authorships(works).where("author_id is not null").groupBy("work_id", "author_id", "date").agg(*marks)


def _affiliations(works: DataFrame) -> DataFrame:
    return _authorships(works).select("work_id", "date", "author_id", "author_position", F.explode("institutions").alias("i")).select("work_id", "date", "author_id", "author_position", F.col("i.id").alias("institution_id")).where("institution_id is not null")


def institutions(works: DataFrame) -> DataFrame:
    return _affiliations(works).groupBy("work_id", "institution_id", "date").agg(*[F.count(F.when(F.col("author_position") == p, 1)).alias(f"{p}_author_count") for p in POSITIONS])


def author_institutions(works: DataFrame) -> DataFrame:
    return _affiliations(works).where("author_id is not null").groupBy("author_id", "institution_id", "date").agg(F.count(F.lit(1)).alias("author_use_institution_count"))


def sources(works: DataFrame) -> DataFrame:
    s = F.col("primary_location.source")
    flat = works.select("work_id", s["id"].alias("source_id"), "date", F.col("primary_location.is_oa").cast("int").alias("location_is_oa"), s["is_oa"].cast("int").alias("source_is_oa"), s["is_in_doaj"].cast("int").alias("source_is_in_doaj"), s["type"].alias("source_type"))
    return flat.where("source_id is not null").select("work_id", "source_id", "date", *null_marks(["location_is_oa", "source_is_oa", "source_is_in_doaj"]), *one_hot("source_type", SOURCE_TYPES))


def topics(works: DataFrame) -> DataFrame:
    flat = works.select("work_id", F.explode("topics").alias("t"), "date").select("work_id", F.col("t.id").alias("topic_id"), "date", F.col("t.score").alias("topic_score"))
    return flat.where("topic_id is not null").select("work_id", "topic_id", "date", F.coalesce("topic_score", F.lit(0.0)).alias("topic_score"), F.col("topic_score").isNull().cast("int").alias("topic_score_is_null"))


TABLES = {"works_basic": basic, "works_citation": citations, "works_author": authors, "works_institution": institutions, "works_source": sources, "works_topic": topics, "author_institution": author_institutions}
