"""Text column functions (T1-T14, P5, G5, G6), all built from native Spark
functions so they stay in the JVM and inside whole-stage code generation.

Every function maps ``Column -> Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxomatch.functions.stopwords import ENGLISH

# ---------------------------------------------------------------------------
# Fixed values of the text rules.  They must stay as they are for the results
# to match: the path rewrite (in this order), the LAST-text separator, the
# product text joiners, the title split, the typed-path pattern and the chunk
# size of the corpus.
PATH_DOUBLE_DASH = "--"
PATH_DOUBLE_DASH_TEXT = " to "
PATH_DASH = "-"
PATH_DASH_TEXT = " "
PATH_SLASH = "/"
PATH_SLASH_TEXT = " for "
TYPE_DOUBLE_DASH_TEXT = " type: "
LAST_SEPARATOR = " for "
CATEGORIZE_AS = " categorize as "
LABEL_JOIN = " or "
TITLE_SEPARATOR = ","
SHORT_HEAD_MAX = 2
TYPE_PATTERN = " type: (.*?) for "
TYPE_PATTERN_FIRST = "type: (.*?) for "
TYPE_JOIN = "  "
MISSING_TEXTS = ("nan", "None")
CHUNK_WORDS = 2000
# ---------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(s: str) -> Column:
    return F.lit(s)


# --------------------------------------------------------------------------- category paths

def path_text(path: Column | str, double_dash: str = PATH_DOUBLE_DASH_TEXT) -> Column:
    """``--`` -> `` to `` (or `` type: ``), ``-`` -> space, ``/`` -> `` for ``.

    Literal replacements, applied in this order.
    """
    t = F.replace(_c(path), _lit(PATH_DOUBLE_DASH), _lit(double_dash))
    t = F.replace(t, _lit(PATH_DASH), _lit(PATH_DASH_TEXT))
    return F.replace(t, _lit(PATH_SLASH), _lit(PATH_SLASH_TEXT))


def path_parts(path: Column | str) -> Column:
    """The parts of a path."""
    return F.split(_c(path), PATH_SLASH, -1)


def path_level(path: Column | str) -> Column:
    """Depth of a path = number of parts."""
    return F.size(path_parts(path))


def path_leaf(path: Column | str) -> Column:
    """Last part of a ``/`` path (also the file name of a file path)."""
    return F.substring_index(_c(path), PATH_SLASH, -1)


def last_text(text: Column | str, sep: str = LAST_SEPARATOR) -> Column:
    """T4: the part after the last `` for `` of the rewritten text (all of it if none)."""
    return F.substring_index(_c(text), sep, -1)


# --------------------------------------------------------------------------- typed paths

def extract_all(text: Column | str, pattern: str = TYPE_PATTERN, join: str = TYPE_JOIN) -> Column:
    """Every match of group 1 joined by two spaces; ``''`` when none.

    U3: the reference applies this per row in Python; here it is one native
    expression (``regexp_extract_all``), no UDF.
    """
    return F.array_join(F.regexp_extract_all(_c(text), _lit(pattern), F.lit(1)), join)


def extract_first(text: Column | str, pattern: str = TYPE_PATTERN_FIRST) -> Column:
    """Group 1 of the first match, null when there is none."""
    t = _c(text)
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))


# --------------------------------------------------------------------------- products

def vendor_labels(vendor_category: Column | str) -> Column:
    """T5: ``vendorCategory`` -> ``array<string>`` without evaluating it.

    * null, ``nan``, ``None``, ``[]``          -> empty array
    * a list literal ``['A','B']``              -> its elements (``None`` -> null)
    * anything else (also an unparsable list)   -> one literal label
    """
    v = _c(vendor_category)
    as_json = F.regexp_replace(v, r"(?<=[\[,\s])None(?=[\],\s])", "null")
    parsed = F.from_json(as_json, "array<string>")
    is_list = v.startswith("[") & v.endswith("]")
    return (F.when(v.isNull() | v.isin(*MISSING_TEXTS), F.array().cast("array<string>"))
            .when(is_list & parsed.isNotNull(), parsed)
            .otherwise(F.array(v)))


def title_head(title: Column | str, legacy_nan: bool = False) -> Column:
    """First comma part of the title; when it has at most two characters the
    first two parts joined by a space (the second keeps its leading space).

    A missing title is the empty text (``legacy_nan=True``: the text ``nan``).
    """
    t = F.coalesce(_c(title), _lit("nan" if legacy_nan else ""))
    parts = F.split(t, TITLE_SEPARATOR, -1)
    first = F.element_at(parts, 1)
    return F.when(F.length(first) <= SHORT_HEAD_MAX, F.array_join(F.slice(parts, 1, 2), " ")).otherwise(first)


def label_suffix(labels: Column, joiner: str = CATEGORIZE_AS) -> Column:
    """T7/T8 suffix: ``joiner`` + labels joined by `` or ``; empty when the list is
    empty or its first element is missing."""
    ok = (F.size(labels) > 0) & F.try_element_at(labels, F.lit(1)).isNotNull()
    return F.when(ok, F.concat(_lit(joiner), F.array_join(labels, LABEL_JOIN))).otherwise(_lit(""))


def product_text(title: Column | str, vendor_category: Column | str, joiner: str = CATEGORIZE_AS,
                 legacy_nan: bool = False) -> Column:
    """T7 (``joiner=' categorize as '``) / T8 (``joiner=' '``)."""
    return F.concat(title_head(title, legacy_nan), label_suffix(vendor_labels(vendor_category), joiner))


def _text_or_nan(c: Column | str) -> Column:
    return F.coalesce(_c(c), _lit("nan"))


def product_word_text(title: Column | str, vendor_category: Column | str) -> Column:
    """Title + vendor category lower-cased with the texts ``none``/``nan`` deleted
    (as substrings, like the reference's plain replace)."""
    vc = F.replace(F.replace(F.lower(_text_or_nan(vendor_category)), _lit("none"), _lit("")),
                   _lit("nan"), _lit(""))
    return F.concat_ws(" ", _text_or_nan(title), vc)


def corpus_text(title: Column | str, description: Column | str, vendor_category: Column | str) -> Column:
    """Title, description and vendor category joined by a space (missing -> ``nan``)."""
    return F.concat_ws(" ", _text_or_nan(title), _text_or_nan(description), _text_or_nan(vendor_category))


# --------------------------------------------------------------------------- cleaning

def stop_words() -> tuple[str, ...]:
    """Spark's default English stop words, shipped with the package: neither
    a JVM nor the MLlib jar is needed (the DuckDB oracle uses them too)."""
    return ENGLISH


def normalize_letters(text: Column | str, cat: bool = False) -> Column:
    """T11 without the stop words: optional path rewrite, lower case, every
    run of characters that are not ASCII letters -> one space, trimmed.  A
    missing text gives ``''``.

    The rule "non-letter -> space, then runs of whitespace -> one space" is
    the same as "runs of non-letters -> one space"; one regex pass does it.
    """
    t = _c(text)
    if cat:
        t = path_text(t)
    return F.coalesce(F.trim(F.regexp_replace(F.lower(t), "[^a-z]+", " ")), _lit(""))


def words(text: Column | str) -> Column:
    """Tokens of a normalised text (only letters and single spaces are left).

    The text is referenced once, so an expensive input is not evaluated twice.
    """
    return F.array_remove(F.split(_c(text), " ", -1), "")


def drop_stop_words(tokens: Column) -> Column:
    """Remove stop words from an ``array<string>``.

    Same list and rule as MLlib's ``StopWordsRemover`` on lower-case words.
    """
    # An IN list over 10 literals is planned as a hash set (OptimizeIn -> InSet).
    stop = stop_words()
    return F.filter(tokens, lambda w: ~w.isin(*stop))


def is_stop_word(word: Column | str) -> Column:
    """Predicate for exploded tokens (stays in generated code)."""
    return _c(word).isin(*stop_words())


def clean_words(text: Column | str, cat: bool = False) -> Column:
    """T11 as tokens: ``normalize_letters`` -> words -> stop words removed."""
    return drop_stop_words(words(normalize_letters(text, cat)))


def clean_text(text: Column | str, cat: bool = False) -> Column:
    """``clean_words`` joined by single spaces."""
    return F.array_join(clean_words(text, cat), " ")


def chunk_words(tokens: Column, size: int = CHUNK_WORDS) -> Column:
    """``array<array<string>>`` of consecutive runs of at most ``size`` words.

    ``tokens`` is referenced several times: pass a column that is already
    computed (a name), not the cleaning expression itself.
    """
    return F.when(
        F.size(tokens) > 0,
        F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size)),
                    lambda i: F.slice(tokens, i + 1, size)),
    ).otherwise(F.array().cast("array<array<string>>"))


def explode_tokens(df, tokens: Column, name: str = "word", pos: str | None = None, *keep):
    """One row per element of a computed token array (optionally with its position).

    Uses the ``_outer`` generators and drops the null row of an empty array
    afterwards: for a plain ``explode`` Catalyst infers ``size(tokens) > 0``
    and pushes it below the projection, which evaluates the whole cleaning
    expression a second time.
    """
    if pos:
        out = df.select(*keep, F.posexplode_outer(tokens).alias(pos, name))
    else:
        out = df.select(*keep, F.explode_outer(tokens).alias(name))
    return out.where(F.col(name).isNotNull())


def not_empty(text: Column | str) -> Column:
    """P5: predicate, the text is not empty."""
    return F.length(_c(text)) > 0
