"""Files of question papers and answer sheets: what their names tell, filters, and which sheet belongs to which paper.

Words for subjects and levels are parameters: lists of (part of a name, label) in order; the first part that occurs counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

GENERAL = "綜合"
# Parts of the names of answer sheets; marks of the two upper grades.
SHEET_WORDS = ("答案", "解答", "answer")
GRADE_WORDS = (("小六", "6"), ("六年", "6"), ("小五", "5"), ("五年", "5"))

Labels = Sequence[tuple[str, str]]


def first_label(name: Column, labels: Labels, default: str) -> Column:
    """The label of the first part that occurs in a name."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(part)), F.lit(label)) for part, label in labels], F.lit(default))


def grade(name: Column) -> Column:
    """A digit before 年, else one of two written grades, else ''."""
    digit = F.regexp_extract(name, r"([0-9])年", 1)
    return F.when(digit != "", digit).otherwise(first_label(name, GRADE_WORDS, ""))


def is_answer_sheet(name: Column) -> Column:
    """M06."""
    low = F.lower(name)
    out = F.lit(False)
    for w in SHEET_WORDS:
        out = out | F.contains(low, F.lit(w))
    return out


def exam_year(name: Column) -> Column:
    """A year from 100 to 199 that stands alone, else ''."""
    return F.regexp_extract(name, r"(?<![0-9])(1[0-9]{2})(?![0-9])", 1)


def file_meta(files: DataFrame, name: str, subjects: Labels, levels: Labels, archive: str | None = None, default_level: str = "elementary") -> DataFrame:
    """`files` with subject, grade, level, label (the name without folders and ending) and is_sheet."""
    label = F.regexp_replace(F.regexp_replace(F.col(name), r"^.*[/\\\\]", ""), r"\.[^.]*$", "")
    held = files.withColumn("label", label)
    whole = F.concat_ws(" ", F.col(archive), F.col("label")) if archive else F.col("label")
    return held.withColumn("subject", first_label(F.col("label"), subjects, GENERAL)).withColumn("grade", grade(F.col("label"))).withColumn("level", first_label(whole, levels, default_level)).withColumn("is_sheet", is_answer_sheet(F.col("label")))


def matches(level: str, subjects: Sequence[str] = (), grades: Sequence[str] = ()) -> Column:
    """a filter over file_meta's columns; 'both' are the two lower levels, an unknown grade passes."""
    out = F.col("level").isin("elementary", "middle_school") if level == "both" else F.col("level") == level
    if subjects:
        out = out & F.col("subject").isin(*subjects)
    return out & ((F.col("grade") == "") | F.col("grade").isin(*grades)) if grades else out


def pair_sheets(files: DataFrame, name: str, order: str, subjects: Labels) -> DataFrame:
    """Paper, sheet: each question paper of a group of files with the first answer sheet (by `order`) that fits, or null.

    Years must be equal where both are known, subjects unless the paper's is the general one. A theta join, made of equi-joins:
    sheets are first reduced to the first of each (year, subject), so each paper meets a few rows and no pairs of all files arise.
    Repeated names count once. Null names are left out.
    """
    f = files.select(F.col(name).alias("name"), F.col(order).alias("place")).filter("name is not null").groupBy("name").agg(F.min("place").alias("place"))
    f = f.withColumn("year", exam_year(F.col("name"))).withColumn("subject", first_label(F.col("name"), subjects, GENERAL)).withColumn("sheet", is_answer_sheet(F.col("name")))
    sheets, papers = f.filter("sheet"), f.filter("not sheet").select("name", "year", "subject")
    first = F.struct("place", "name").alias("s")
    # A general paper takes a sheet of any subject, a paper without a year one of any year, a sheet without a year fits all.
    each = sheets.select("year", "subject", first)
    keys = each.unionByName(each.withColumn("subject", F.lit("*"))).unionByName(each.filter("year <> ''").withColumn("year", F.lit("*"))).unionByName(each.filter("year <> ''").withColumn("year", F.lit("*")).withColumn("subject", F.lit("*")))
    best = keys.groupBy("year", "subject").agg(F.min("s").alias("s"))
    wanted_subject = F.when(F.col("subject") == GENERAL, "*").otherwise(F.col("subject"))
    wanted = papers.select("name", wanted_subject.alias("subject"), F.explode(F.array(F.when(F.col("year") == "", "*").otherwise(F.col("year")), F.lit(""))).alias("year"))
    return wanted.join(best, ["year", "subject"], "left").groupBy(F.col("name").alias("paper")).agg(F.min("s")["name"].alias("sheet"))
