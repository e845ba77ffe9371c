"""Queries of the numbered problems, over the whole given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_root, table
from . import leakage, linkage, matching, mixing, splitting, survivor, topn, variants
from . import vectors as V


def _live(spark: SparkSession, d: str) -> DataFrame:
    return V.live_vectors(table(spark, d, "vectors_vec_vector_chunks00"), table(spark, d, "vectors_vec_rowids"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return V.similarity_clusters(_live(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = V.forest_neighbours(_live(spark, d))
    return near.select(F.least("id", "nbr").alias("rowid_lo"), F.greatest("id", "nbr").alias("rowid_hi")).distinct()


def p1_typical(spark: SparkSession, d: str) -> DataFrame:
    """Size and three most typical members of every cluster."""
    live = _live(spark, d)
    return V.typical_members(live, V.similarity_clusters(live))


#: Texts that stand for "no full text".
NO_TEXT = ["", "-", "n/a", "na", "tbd", "null", "none", "nil", "unknown", "pending", "not available", "full text not available", "no full text", "no summary", "todo"]
#: Access methods that name where a full text came from.
ACCESS = ["pmc", "europepmc", "unpaywall", "biorxiv"]


def pmid_number(c: str) -> F.Column:
    """Digits of a PubMed number in any notation, without leading zeros; NULL for placeholders."""
    digits = F.regexp_extract(F.trim(c), r"([0-9]+)(?:\.0*)?[^0-9]*$", 1)
    return F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit(""))


def judged_papers(papers: DataFrame) -> DataFrame:
    """papers with pmid_number and, for the four respects, a value and the level of its quality.

    Values that say nothing (no text, no date) are NULL and make no claim.
    """
    plain = F.regexp_replace(F.regexp_replace("full_text_summary", r"(?s)<[^>]*>", " "), r"&(?:nbsp|#160|#xa0);|\u00a0", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.lower(plain), r"[.!?\s]+$", ""))
    status = F.regexp_replace(F.regexp_replace(F.lower("status"), r"^\s+|\s+$", ""), r"[\s_-]+", "_")
    access = F.regexp_replace(F.lower("access_method"), r"[\s_-]+", "")
    absent = F.coalesce(bare, F.lit("")).isin(NO_TEXT)
    micros = F.unix_micros(F.col("summarized_date").cast("timestamp"))
    return papers.select(
        pmid_number("pmid").alias("pmid_number"), "id", "source",
        status.alias("v_status"), F.when(status == "summary_ready", 1.0).otherwise(0.0).alias("q_status"),
        access.alias("v_access"), F.when(access.isin(ACCESS), 1.0).otherwise(0.0).alias("q_access"),
        F.when(~absent, F.sha2(bare, 256)).alias("v_text"), F.when(absent, 0.0).otherwise(1.0).alias("q_text"),
        micros.alias("v_date"), micros.cast("double").alias("q_date"),
    ).where("pmid_number is not null and id is not null")


JUDGED = {"status": ("v_status", "q_status"), "access": ("v_access", "q_access"), "text": ("v_text", "q_text"), "date": ("v_date", "q_date")}


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving row of every PubMed number held by two or more rows, and the record fused from the group."""
    return survivor.surviving_rows(judged_papers(table(spark, d, "papers")), "pmid_number", "id", JUDGED, "source")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Survivors that alone are as good as the fused value in every respect."""
    return p3_survivors(spark, d).where("complete and strictly").select("pmid_number", "id")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matched rows of papers and endnote_records with their confidence."""
    none = F.lit(None).cast("string")
    left = table(spark, d, "papers").select(F.col("id").alias("node"), "title", "authors", "journal", F.year("pub_date").alias("year"), "pmid", "doi")
    right = table(spark, d, "endnote_records").select(F.col("rec_no").alias("node"), "title", "authors", F.col("secondary_title").alias("journal"), F.col("pub_year").alias("year"), none.alias("pmid"), none.alias("doi"))
    return matching.match_tables(left, right).withColumnsRenamed({"left_id": "id", "right_id": "rec_no"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("id", "rec_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Repeats within all rows: the older two thirds of the runs are accepted first, the rest is then linked to them."""
    papers = table(spark, d, "digest_papers")
    sizes = papers.groupBy("batch").agg(F.count("*").alias("n"))
    w = Window.orderBy("batch")  # over one row a run, not over the papers
    cut = sizes.withColumn("part", F.sum("n").over(w) / F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cut = cut.where("part <= 0.67").agg(F.max("batch")).first()[0]
    late = F.coalesce(F.col("batch") > F.lit(cut or ""), F.lit(False))
    path = f"{shared_root(spark)}/history-{uuid.uuid4().hex}"
    for batch in (papers.where(~late), papers.where(late)):
        linkage.link_batch(linkage.read_records(batch), linkage.History(spark, path))  # each finds the history on storage
    return linkage.first_pairs(linkage.History(spark, path))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "digest_papers").select("batch", "sonnet_combined", "id").where(F.col("batch").rlike(r"\S"))
    return topn.top_n_per_group(rows, ["batch"], "sonnet_combined", "id", 5).select("batch", "id")


P6_SQL = r"""
select batch, id from (
  select batch, id, row_number() over (partition by batch order by sonnet_combined desc, id) as r
  from digest_papers where regexp_matches(batch, '\S') and sonnet_combined is not null and not isnan(sonnet_combined)
) where r <= 5
"""


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    grants = table(spark, d, "digest_grants")
    people = table(spark, d, "digest_papers").select(F.explode("authors").alias("name")).unionByName(grants.select(F.col("pi").alias("name")))
    names = people.select(F.lit("person").alias("kind"), "name").unionByName(grants.select(F.lit("org").alias("kind"), F.col("organization").alias("name")))
    return variants.name_variants(names)


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items of every affected document, with the item words covered and those that agree."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Ids and sizes of the documents without a leak."""
    docs = table(spark, d, "documents")
    return leakage.without_leaks(docs.select("doc_id", "source", "n_chars"), p8_leaks(spark, d))


def p8_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents after their leaked spans were cut out: spans, characters cut and kept."""
    docs = table(spark, d, "documents")
    cut = leakage.cut_leaks(docs, leakage.find_leaks(docs, table(spark, d, "eval_items"), spans=True))
    return cut.select("doc_id", "spans", "cut_chars", F.length("text").alias("n_chars"))


#: Domains of the sources, the upper level of the mixing tree: what is written outside and what is written here.
DOMAINS = {"abstract_feed": "literature", "preprint_text": "literature", "grant_abstract": "literature", "deep_summary": "literature", "vault": "notes", "topic_page": "notes", "review_note": "notes", "lab_log": "notes"}


def _mixture(spark: SparkSession, d: str, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mix(mixing.with_token_counts(docs), table(spark, d, "mix_targets"), total, domains=DOMAINS)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the mix with its number of uses; all target shares are met."""
    return _mixture(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source at the largest total that meets all targets."""
    return _mixture(spark, d)[1]


def p9_report_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached when the mix is to hold as many tokens as the targeted sources do: small sources run short, and those of their domain take over first."""
    docs = mixing.with_token_counts(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    counted = mixing.stash(docs)
    targets = table(spark, d, "mix_targets")
    total = counted.join(targets, "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.mix(counted, targets, float(total), domains=DOMAINS)[1]


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_typical": p1_typical,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_clean": p8_clean,
    "p8_trimmed": p8_trimmed,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p9_report_corpus_size": p9_report_corpus_size,
    "p10_pieces": p10_pieces,
}
ORACLE: dict[str, str] = {"p6_found": P6_SQL}
