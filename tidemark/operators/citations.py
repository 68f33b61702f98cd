"""Validation of a report's citations against verdicts on (claim, citation) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import cut, markers, sentences, strip_citations

MOST_PAIRS = 40


def claims(reports: DataFrame, lists: bool = False) -> DataFrame:
    """(report_id, report) to (report_id, claim_no, claim, markers): sentences with citation markers, in order."""
    rows = reports.select("report_id", F.posexplode(sentences("report")).alias("pos", "claim"))
    rows = rows.withColumn("markers", markers(F.col("claim"), lists)).where(F.size("markers") > 0)
    order = Window.partitionBy("report_id").orderBy("pos")
    return rows.select("report_id", (F.row_number().over(order) - 1).cast("long").alias("claim_no"), "claim", "markers")


def pairs(claimed: DataFrame, cites: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Claims by the citations (report_id, n, quote) they mark, those with quotes, at most `most` a report: pid counts from 0."""
    rows = claimed.select("report_id", "claim_no", "claim", F.posexplode("markers").alias("k", "n"))
    rows = rows.join(cites.where("quote <> ''").select("report_id", "n", cut("quote", 350).alias("quote")), ["report_id", "n"])
    order = Window.partitionBy("report_id").orderBy("claim_no", "k")
    return rows.withColumn("pid", F.row_number().over(order) - 1).where(F.col("pid") < most).select("report_id", "pid", "n", "claim_no", cut("claim", 280).alias("claim"), "quote")


def citation_verdicts(paired: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(report_id, n, yes, partial, no, verdict): NO or PARTIAL only where no pair says YES; all unknown counts as YES."""
    v = paired.join(verdicts.select("report_id", "pid", "verdict"), ["report_id", "pid"], "left").withColumn("v", F.coalesce("verdict", F.lit("UNKNOWN")))
    rows = v.groupBy("report_id", "n").agg(F.count_if(F.col("v") == "YES").alias("yes"), F.count_if(F.col("v") == "PARTIAL").alias("partial"), F.count_if(F.col("v") == "NO").alias("no"), F.min("pid").alias("first_pid"))
    rule = F.when((F.col("no") > 0) & (F.col("yes") == 0), "NO").when((F.col("partial") > 0) & (F.col("yes") == 0), "PARTIAL").otherwise("YES")
    return rows.withColumn("verdict", rule)


def failed_claims(paired: DataFrame, per_citation: DataFrame) -> DataFrame:
    """Every pair of a citation whose verdict is NO."""
    return paired.join(per_citation.where("verdict = 'NO'").select("report_id", "n", "verdict"), ["report_id", "n"]).select("report_id", "pid", "n", "claim", "verdict")


def cleaned(reports: DataFrame, per_citation: DataFrame) -> DataFrame:
    """Reports without the citations of verdict NO, removed in order of first use, with counts of checked and unsupported."""
    one = F.struct("first_pid", "n", "verdict")
    rows = per_citation.groupBy("report_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    gone = F.transform(F.filter("all", lambda x: x["verdict"] == "NO"), lambda x: x["n"])
    rows = rows.select("report_id", F.size("all").alias("checked"), gone.alias("gone"))
    out = reports.join(rows, "report_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    return out.select("report_id", strip_citations("report", F.col("gone")).alias("report"), F.coalesce("checked", F.lit(0)).alias("checked"), F.size("gone").alias("unsupported"))


def with_verdicts(cites: DataFrame, per_citation: DataFrame) -> DataFrame:
    """Citations with their verdict, UNCHECKED where there is none."""
    return cites.join(per_citation.select("report_id", "n", "verdict"), ["report_id", "n"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNCHECKED")))
