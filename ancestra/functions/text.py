"""Column functions on titles, names, words and quoted sources."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType

#: Words too common to tell works apart.
STOPWORDS = """the and for with that this from are our can which have has been using used use new two its their
these such into than also based via over more not all one only between both each other""".split()

WORD = "[a-z][a-z0-9-]{2,}"

#: The tag that ends a quoted source, and scripts that write the family name first.
SOURCE_END = "</source>"
FAMILY_FIRST = "[぀-ヿ㐀-鿿가-힯]"


def strip_prefix(column: Column) -> Column:
    """The text after the last slash."""
    return F.regexp_replace(column, "^.*/", "")


def title_key(title: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), F.lit(""))


def display_name(name: Column) -> Column:
    """`Family, Given 1950-` as `Given Family`; some scripts keep the family name first."""
    bare = F.regexp_replace(name, r"\s+[0-9]{4}-([0-9]{4})?$", "")
    parts = F.transform(F.split(bare, ","), lambda p: F.trim(p))
    ordered = F.when(bare.rlike(FAMILY_FIRST), parts).otherwise(F.reverse(parts))
    joined = F.array_join(F.filter(ordered, lambda p: p != ""), " ")
    return F.when(F.size(parts) == 2, joined).otherwise(bare)


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    """Letters without marks, in ASCII: normal form KD has no built-in function."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def first_author_key(authors: Column, ascii_only: bool = False) -> Column:
    """The last run of Latin letters of the first name, or the name without spaces."""
    name = F.try_element_at(authors, F.lit(1))
    plain = F.lower(name if ascii_only else _folded(name))
    run = F.try_element_at(F.regexp_extract_all(plain, F.lit("([a-z]+)"), F.lit(1)), F.lit(-1))
    return F.coalesce(run, F.regexp_replace(name, r"\s", ""), F.lit(""))


@F.pandas_udf(MapType(StringType(), ArrayType(IntegerType())))
def inverted(texts: pd.Series) -> pd.Series:
    """Places by word of texts parted by spaces: built-in functions would sort or deal out all words."""

    def places(x: str | None) -> dict[str, list[int]] | None:
        if x is None:
            return None
        out: dict[str, list[int]] = {}
        for k, word in enumerate(x.split(" ")):
            out.setdefault(word, []).append(k)
        return out

    return texts.map(places, na_action="ignore")


def inverted_to_text(index: Column) -> Column:
    """A map of word to places as text; null for a null or empty map."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def words(title: Column, abstract: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(abstract, F.lit(""))))
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def attribute(value: Column) -> Column:
    """Text that cannot close the tag whose attribute it is."""
    return F.translate(F.translate(value, '"\n\r', "'  "), "<>", "")


def quoted(work_id: Column, title: Column, year: Column, abstract: Column) -> Column:
    body = F.replace(abstract, F.lit(SOURCE_END), F.lit(""))
    head = F.concat(F.lit('<source id="'), attribute(work_id), F.lit('" year="'), attribute(year), F.lit('" title="'), attribute(title), F.lit('">\n'))
    return F.concat(head, body, F.lit("\n" + SOURCE_END))


def byline(authors: Column, year: Column) -> Column:
    """Up to three names, et al. if there are more, and the year."""
    names = F.array_join(F.slice(authors, 1, 3), ", ")
    more = F.when(F.size(authors) > 3, F.lit(" et al.")).otherwise(F.lit(""))
    return F.concat_ws(" · ", F.nullif(F.concat(names, more), F.lit("")), year.cast("string"))
