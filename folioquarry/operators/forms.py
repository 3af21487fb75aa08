"""Form fields: parsing, groups of alternatives as one question, and answers back to the fields. No group is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How the notes of a field say its subject, its group of alternatives and its kind.
SUBJECT = r"^For\s+([^—]+?)\s+—\s+([^.]+)\.\s*(.*)$"
GROUP = r'MUTUALLY EXCLUSIVE GROUP "([^"]+)"\s*\(([^)]*)\)'
KIND = r"(?i)FIELD TYPE:\s*(checkbox|radio button|date)"


def parse_fields(fields: DataFrame) -> DataFrame:
    """Role, subject, label, group, its question and the field's type from the notes of (field_id, notes), and the ``question_id`` the field belongs to."""
    notes = F.coalesce("notes", F.lit(""))
    para = F.trim(F.element_at(F.split(notes, "\n\n"), 1))
    some = lambda p, i, c: F.nullif(F.trim(F.regexp_extract(c, p, i)), F.lit(""))
    label = F.when(para.rlike(SUBJECT), F.trim(F.regexp_extract(para, SUBJECT, 3))).otherwise(para)
    out = fields.select("field_id", some(SUBJECT, 1, para).alias("role"), some(SUBJECT, 2, para).alias("subject"), label.alias("label"), some(GROUP, 1, notes).alias("group"), some(GROUP, 2, notes).alias("group_question"), F.lower(some(KIND, 1, notes)).alias("field_type"))
    return out.withColumn("question_id", F.coalesce("group", F.concat(F.lit("field:"), "field_id")))


def collapse(fields: DataFrame) -> DataFrame:
    """One question per group of alternatives or lone field: ``members`` counts its fields, ``first_member`` is the least."""
    g = fields.groupBy("question_id").agg(F.count(F.lit(1)).alias("members"), F.min("field_id").alias("first_member"), F.max("group_question").alias("question"))
    return g.withColumn("mode", F.when(F.col("members") > 1, "options").otherwise("value"))


def fan_out(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (question_id, choice, value) back to the fields: the chosen one is yes or has the value, others No; unanswered questions give 'Not found'."""
    f = fields.select("question_id", "field_id").join(collapse(fields).select("question_id", "mode"), "question_id").join(answers, "question_id", "left")
    won = F.col("choice") == F.col("field_id")
    value = F.when(F.col("mode") == "value", F.coalesce("value", F.lit("Not found"))).when(won, "yes").when(F.col("choice").isNull(), "Not found").otherwise("No")
    return f.select("question_id", "field_id", value.alias("field_value"))


def faults(fields: DataFrame) -> DataFrame:
    """Fields defined twice, and groups of one member."""
    twice = fields.groupBy("field_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("field_id", F.lit("duplicate").alias("fault"))
    lone = fields.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("field_id").alias("field_id")).where("n = 1").select("field_id", F.lit("no alternative").alias("fault"))
    return twice.unionByName(lone)
