"""Verification: is every claimed figure quoted on the page that it cites?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import columns as C
from veriloom.schemas import MAGNITUDE_ITEMS


def page_text(pages: Column, page: Column) -> Column:
    """Pages count from 1; a page out of range is empty."""
    return F.coalesce(F.when(page >= 1, F.get(pages, page - 1)), F.lit(""))


def with_cited_page(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with `n_pages` and the text of the page they cite: one equi-join, and no more of a document than that page."""
    paged = claims.join(documents.select("doc_id", "pages"), "doc_id", "left")
    return paged.withColumns({"n_pages": F.coalesce(F.size("pages"), F.lit(0)), "page_text": page_text(F.col("pages"), F.col("page"))}).drop("pages")


def _value_quoted(value: Column, scale: Column) -> Column:
    return F.coalesce(C.value_in_numbers(value, scale, F.col("name").isin(*MAGNITUDE_ITEMS), F.col("_numbers")), F.lit(False))


def verify(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """`claims` with `grounded`: null for an abstention, false without evidence, with a page out of range, a quote that is not
    on the page or a figure that is not in the quote; else true. Each quote and page is normalised once per claim."""
    rows = with_cited_page(claims, documents).withColumns({"_on_page": C.quote_on_page("quote", "page_text"), "_numbers": C.numbers_in_text("quote")})
    cited = F.col("page").isNotNull() & F.col("quote").isNotNull() & (F.col("page") >= 1) & (F.col("page") <= F.col("n_pages"))
    grounded = F.when(F.col("value").isNull(), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(cited, F.lit(False)) & F.col("_on_page") & _value_quoted(F.col("value"), F.coalesce("unit_scale", F.lit(1.0))))
    return rows.withColumn("grounded", grounded).drop("_on_page", "_numbers", "page_text", "n_pages")


def unverified(claims: DataFrame) -> DataFrame:
    return claims.withColumn("grounded", F.lit(None).cast("boolean"))


def admit(claims: DataFrame, documents: DataFrame, check_quotes: bool = True) -> DataFrame:
    """Model or replayed claims as fields: `problem` is null for those admitted and says what is wrong with the others.

    Abstentions pass. Sizes of outflows lose their sign, a scale that is not positive is 1, confidence is clamped.
    """
    rows = with_cited_page(claims, documents).withColumns({"_on_page": C.quote_on_page("quote", "page_text"), "_numbers": C.numbers_in_text("quote")})
    value, scale = C.magnitude(F.col("name"), F.col("value")), C.positive_scale(F.col("unit_scale"))
    label = F.concat(F.col("name"), F.lit(": "))
    problem = (
        F.when(F.col("value").isNull(), F.lit(None).cast("string"))
        .when(F.col("page").isNull() | (F.coalesce("quote", F.lit("")) == ""), F.concat(label, F.lit("a value without a page or a quote; cite both, or abstain")))
        .when((F.col("page") < 1) | (F.col("page") > F.col("n_pages")), F.concat(label, F.lit("cites page "), F.col("page"), F.lit(" of "), F.col("n_pages")))
        .when(~F.col("_on_page"), F.concat(label, F.lit("the quote is not on page "), F.col("page")))
        .when(~_value_quoted(value, scale), F.concat(label, F.lit("the figure is not in the quote")))
    )
    made = {"problem": problem if check_quotes else F.lit(None).cast("string"), "value": value, "unit_scale": scale, "confidence": C.clamp(F.col("confidence"))}
    return rows.withColumns(made).drop("_on_page", "_numbers", "page_text", "n_pages")
