"""Text functions as Column expressions: white space, sentences, labels, signatures, caption words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
#: Abbreviations whose period ends no sentence.
ABBREVIATIONS = "fig figs tab tabs al e.g i.e cf vs no nos ref refs approx ca dr mr ms st eq ch pp".split()
#: White-space glyphs whose names leak into cells.
SPACE_GLYPHS = "em en thin hair figure punctuation third quarter sixth zerowidth nb no-break".split()
#: Words of captions that say nothing about their content.
STOPWORDS = (
    "table figure fig supplementary supp continued of the in for and a an to on with from by as at all summary results data"
).split()
#: Labels of tables and figures.
LABEL = (
    r"(?:Supplementary\s+Data\s+|Supplementary\s+|Supplemental\s+|Extended\s+Data\s+|Online\s+)?"
    r"(?:Tables?|TABLES?|Tabs?\.|Figures?|FIGURES?|Figs?\.?)\s+(?:S?\d+|[IVXivx]{1,4})"
)
CAPTION_TAIL = r"(?:[.:\s]|$)"
OCR_PRODUCERS = "ABBYY|Recognition|Tesseract|FineReader|OmniPage|ocrmypdf|Scansoft"
# -------------------------------------------------------------------------------------------------------------------

U = "(?U)"


def strip(c: Column) -> Column:
    """c without white space at its ends, Unicode spaces included."""
    return F.regexp_replace(c, U + r"^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, U + r"\s+", " "))


def split_sentences(c: Column) -> Column:
    """Sentences: cut at a period before white space and a capital or parenthesis, not after an abbreviation. The
    cutting periods go, blank sentences too; null text gives null."""
    stops = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    cut = rf"\.(?=\s+[A-Z(])(?<!(?<![A-Za-z.])(?i:{stops})\.{{1,5}})"  # looks back at such periods alone
    return F.filter(F.transform(F.split(collapse_ws(c), cut), lambda s: F.trim(s)), lambda s: s != "")


def normalize_label(c: Column) -> Column:
    """One key for the spellings of a label."""
    s = F.lower(collapse_ws(c))
    for what in ("supplementary data ", "supplementary ", "supplemental "):
        s = F.replace(s, F.lit(what), F.lit("supp "))
    for pattern, to in (
        (r"(?U)\btabs?\.", "table"),
        (r"(?U)\btables\b", "table"),
        (r"(?U)\bfigures?\b", "fig"),
        (r"(?U)\bfigs?\.", "fig"),
        (r"(?U)\bfigs\b", "fig"),
        (r"[.:,;]+$", ""),
    ):
        s = F.regexp_replace(s, pattern, to)
    return F.regexp_replace(collapse_ws(s), r"^supp (table|fig) (s\d)", "$1 $2")


def label_kind(key: Column) -> Column:
    return F.when(key.contains("table"), "table").otherwise("figure")


def is_supplementary(key: Column) -> Column:
    return key.startswith("supp ")


def caption_label(line: Column, core: str = LABEL) -> Column:
    """The label that a line starts with, or null: such a line is a caption."""
    found = F.regexp_extract(collapse_ws(line), f"^({core}){CAPTION_TAIL}", 1)
    return F.when(found != "", found)


def loose_labels(text: Column, core: str = LABEL) -> Column:
    """Every label in a text."""
    return F.regexp_extract_all(collapse_ws(text), F.lit(rf"(?U)({core})\b"), F.lit(1))


def ends_sentence(prev: Column) -> Column:
    """Whether a caption may follow this line: none, a blank one or one that ends a sentence."""
    flat = collapse_ws(prev)
    return prev.isNull() | (flat == "") | flat.rlike(r"[.!?:][\"')\]]*$")


def is_legend_continuation(gap: Column, longest: Column) -> Column:
    return (gap < 15.0) & (longest >= 40)


def has_hyphen_break(c: Column) -> Column:
    return c.rlike(U + r"[a-z]-\s+[a-z]")


def strip_glyph_names(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?iU)^/(?:{'|'.join(SPACE_GLYPHS)})space\s*", "")


def cell_norm(c: Column) -> Column:
    """A cell without white space, in lower case, with a plain minus."""
    return F.translate(F.lower(F.regexp_replace(c, U + r"\s+", "")), "−", "-")


def format_signature(c: Column) -> Column:
    """A cell's format: digit runs as 9, letter runs as A."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\d+", "9"), r"[A-Za-z]+", "A")


def caption_words(c: Column) -> Column:
    """Distinct content words of a caption, in order of first appearance."""
    words = F.regexp_extract_all(F.lower(collapse_ws(c)), F.lit(r"[A-Za-z][A-Za-z0-9\-]{2,}"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, STOPWORDS)))


def says_continued(c: Column) -> Column:
    return collapse_ws(c).rlike(r"(?i)\(\s*continued\s*\)")


def metadata_suggests_ocr(m: Column) -> Column:
    """Whether a map of metadata names an OCR producer."""
    blob = F.array_join(F.transform(F.map_values(m), lambda v: F.coalesce(v, F.lit(""))), " ")
    return F.coalesce(blob.rlike(f"(?i){OCR_PRODUCERS}"), F.lit(False))
