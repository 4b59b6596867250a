"""Column functions: JVM expressions where Spark has them, Arrow UDFs over `kernels` where it has not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions import kernels
from veriloom.schemas import CLAIM_KEYS, ITEMS, MAGNITUDE_ITEMS

ASKED = f"\n\nReport these items: {', '.join(ITEMS)}. Keys of each: {', '.join(CLAIM_KEYS)}."
FEEDBACK = "Problems with your last answer:"


@F.pandas_udf(T.StringType())
def normalise(text: pd.Series) -> pd.Series:
    return text.map(kernels.normalise)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def numbers_in_text(text: pd.Series) -> pd.Series:
    return text.map(kernels.numbers_in)


@F.pandas_udf(T.DoubleType())
def parse_number(text: pd.Series) -> pd.Series:
    return text.map(kernels.whole_number).astype("float64")


@F.pandas_udf(T.BooleanType())
def quote_on_page(quote: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([kernels.on_page(q, p) for q, p in zip(quote, page)], dtype=bool)


@F.pandas_udf(T.StringType())
def safe_doc_id(filename: pd.Series) -> pd.Series:
    return filename.map(lambda x: None if x is None else kernels.slug(x))


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_TEXT, _REAL, _INT = T.StringType(), T.DoubleType(), T.IntegerType()
_HIT = _struct(item=_TEXT, phrase=_TEXT, confidence=_REAL, span=_INT)


def lines(page: Column) -> Column:
    """A page's lines; only a line feed ends one."""
    return F.split(F.coalesce(page, F.lit("")), "\n", -1)


@F.pandas_udf(T.ArrayType(_HIT))
def label_hits(line: pd.Series) -> pd.Series:
    """All labels on a line, in order of precedence."""
    return line.map(lambda x: [{"item": h.item, "phrase": h.phrase, "confidence": h.confidence, "span": h.span} for h in kernels.label_hits(x or "")])


@F.pandas_udf(_HIT)
def best_label(line: pd.Series) -> pd.DataFrame:
    """The label that counts; nulls where a line has none."""
    found = [kernels.best_label(x or "") for x in line]
    return pd.DataFrame({"item": [h and h.item for h in found], "phrase": [h and h.phrase for h in found], "confidence": [h and h.confidence for h in found], "span": pd.array([h and h.span for h in found], "Int32")})


@F.pandas_udf(T.ArrayType(_struct(line_no=_INT, item=_TEXT, confidence=_REAL, value=_REAL, scale=_REAL, quote=_TEXT, wrapped=T.BooleanType())))
def page_candidates(page: pd.Series) -> pd.Series:
    """The labelled lines of a page that have an amount."""
    return page.map(lambda x: [c._asdict() for c in kernels.page_candidates(x)])


@F.pandas_udf(_struct(value=_REAL, scale=_REAL))
def plausible_number(text: pd.Series) -> pd.DataFrame:
    """The first number that may be an amount, and its inline scale; nulls where there is none."""
    found = [kernels.plausible_number(x or "") for x in text]
    return pd.DataFrame({"value": [n and n.value for n in found], "scale": [n and n.scale for n in found]}).astype("float64")


@F.pandas_udf(T.DoubleType())
def unit_scale(page: pd.Series) -> pd.Series:
    """What a page says its units are; 1 where it says nothing."""
    return page.map(lambda x: kernels.declared(x or "", "units") or 1.0).astype("float64")


@F.pandas_udf(T.StringType())
def currency(page: pd.Series) -> pd.Series:
    return page.map(lambda x: kernels.declared(x or "", "currency"))


def numbers_match(a: Column, b: Column, rel: float = 0.01, absolute: float = 1.0) -> Column:
    """Within `absolute`, or within `rel` of the larger; false when either is null."""
    far = F.abs(a - b)
    return F.coalesce((far <= absolute) | (far <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def prompt(pages: Column, problems: Column | None = None, most_pages: int = 60) -> Column:
    """What a model is asked: numbered pages, the items, and what was wrong with its last answer."""
    numbered = F.transform(F.slice(pages, 1, most_pages), lambda p, i: F.concat(F.lit('<page number="'), (i + 1).cast("string"), F.lit('">\n'), F.coalesce(p, F.lit("")), F.lit("\n</page>")))
    asked = F.concat(F.array_join(numbered, "\n"), F.lit(ASKED))
    if problems is None:
        return asked
    return F.concat(asked, F.when(F.size(problems) > 0, F.concat(F.lit(f"\n\n{FEEDBACK}"), F.array_join(F.transform(problems, lambda p: F.concat(F.lit("\n- "), p)), ""))).otherwise(""))


def close_to(found: Column, target: Column, rel: float = 0.01) -> Column:
    """Relative to the target; against a target of zero, within `rel` of it."""
    return (found == target) | F.when(target == 0, F.abs(found) <= rel).otherwise(F.abs(found - target) <= F.lit(rel) * F.abs(target))


def value_in_numbers(value: Column, scale: Column, magnitude: Column, numbers: Column, rel: float = 0.01) -> Column:
    """Is one of the numbers the value, or the value in full units? `magnitude` compares sizes only."""
    size = lambda x: F.when(magnitude, F.abs(x)).otherwise(x)
    full = ~scale.isin(0.0, 1.0)
    return F.exists(numbers, lambda n: close_to(size(n), size(value), rel) | (full & close_to(size(n), size(value * scale), rel)))


def clamp(x: Column) -> Column:
    """To [0, 1]; what is no number is 0."""
    number = x.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def tolerant_float(x: Column) -> Column:
    """A float with `,` and `_` taken out, else null."""
    return F.trim(F.regexp_replace(x, "[,_]", "")).try_cast("double")


def positive_scale(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(1.0))


def magnitude(name: Column, value: Column) -> Column:
    return F.when(name.isin(*MAGNITUDE_ITEMS), F.abs(value)).otherwise(value)


def first_of_keys(text: Column) -> Column:
    """`k=v k=v` as a map; the first of equal keys counts, tokens without `=` and empty keys are passed over."""
    pairs = F.filter(F.split(text, " "), lambda t: F.instr(t, "=") > 1)
    keyed = F.transform(pairs, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.substr(t, F.instr(t, "=") + 1).alias("value")))
    keys = F.array_distinct(F.transform(keyed, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(keyed, lambda p: p["key"] == k)[0]["value"]))


def json_block(text: Column) -> Column:
    """From the first `{` to the last `}`, else null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_string("%.1f%%", x * 100))


def bar(count: Column, total: Column, width: int = 28) -> Column:
    """`#` for the share, `.` for the rest; halves go to the even length."""
    filled = F.bround(F.lit(float(width)) * count / F.nullif(total, F.lit(0))).cast("int")
    return F.coalesce(F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled)), F.lit(""))
