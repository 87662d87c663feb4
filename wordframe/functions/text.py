"""Column functions over words and raw cells."""
from pyspark.sql import Column, functions as F

# The punctuation stripped from the outside of a word before a frequency lookup.
OUTER_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "“”‘’…"
# Fixed value: the cell that stands for a missing duration.
MISSING_CELL = "."
SPACE = r"[\s\p{Z}]"


def strip_outer(word: Column) -> Column:
    return F.btrim(word, F.lit(OUTER_PUNCTUATION))


def has_space(word: Column) -> Column:
    return word.rlike(SPACE)


def compact_match(whole: Column, word: Column) -> Column:
    """A phrase form names the displayed word when it equals it without blanks."""
    return whole.isNotNull() & (F.replace(whole, F.lit(" "), F.lit("")) == word)


def canonical_cell(cell: Column, kind: Column) -> Column:
    """Sheet cell to text: truth values in capitals, whole numbers without a fraction."""
    value = cell.try_cast("double")
    integral = value == F.floor(value)
    return (F.when(kind == "b", F.upper(cell))
            .when((kind == "n") & integral, value.cast("bigint").cast("string"))
            .when(kind == "n", value.cast("string")).otherwise(cell))


def was_coerced(kind: Column) -> Column:
    return kind.isin("b", "n")


def duration_status(cell: Column) -> Column:
    """'missing', 'invalid' or 'valid' for a duration cell."""
    value = cell.try_cast("double")
    ordinary = value.isNotNull() & ~F.isnan(value) & (value != float("inf")) & (value > 0)
    return (F.when(cell.isNull() | cell.isin(MISSING_CELL, ""), "missing").when(ordinary, "valid")
            .otherwise("invalid"))


def valid_duration(cell: Column) -> Column:
    return F.when(duration_status(cell) == "valid", cell.try_cast("double"))


def reason_text(reasons: dict[str, Column]) -> Column:
    """Names of the conditions that hold, joined by ';'; empty when none does."""
    return F.concat_ws(";", *[F.when(c, F.lit(name)) for name, c in reasons.items()])


def surface_flags(word: Column, prefix: str = "") -> dict[str, Column]:
    """Six 0/1 controls of the printed form."""
    patterns = {"stop": r"[.!?]", "comma": ",", "colon": "[:;]", "quote": "[\"“”]", "digit": r"\p{Nd}",
                "capital": r"^\p{Lu}"}
    return {f"{prefix}{name}": word.rlike(p).cast("double") for name, p in patterns.items()}
