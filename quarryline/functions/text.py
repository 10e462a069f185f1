"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of tag references and screen changes in screen code.
TAG_PATTERNS = (
    r'GetTagValue\("([^"]+)"\)',
    r'SetTagValue\("([^"]+)"',
    r'SetBitInTag\("([^"]+)"',
    r'ResetBitInTag\("([^"]+)"',
    r'TagValue\("([^"]+)"\)',
    r'"([A-Z][A-Z0-9_]*_[A-Z0-9_ .\-]+)"',
    r'"(DB_[A-Z_0-9][A-Z_0-9 .\-]+)"',
)
NAVIGATION_PATTERN = r'ChangeScreen\("([^"]+)"'
#: Event suffixes of function names with their labels.
EVENT_SUFFIXES = {
    "_OnUp": "OnUp (release)", "_OnDown": "OnDown (press)", "_OnLoaded": "OnLoaded (screen init)", "_OnClick": "OnClick",
    "_OnChange": "OnChange", "_OnMouseEnter": "OnMouseEnter", "_OnMouseLeave": "OnMouseLeave",
}
#: Parts of strings that are no screen names.
NO_SCREEN_NAMES = (
    "LAYER", "MODULE", "FONT", "COLOR", "IMAGE", "STYLE", "TOOLBAR", "BUTTON_", "FACEPLATE", "TEMPLATE", "VERSION", "AUTHOR", "CREATED", "MODIFIED", "SIEMENS",
)
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg")


def token_count(text: Column) -> Column:
    """A token for each four whole characters."""
    return F.floor(F.length(text) / 4).cast("long")


def sentences(text: Column) -> Column:
    """Parts between white space that follows a full stop, an exclamation or a question mark."""
    return F.split(text, r"(?<=[.!?])\s+")


def paragraphs(text: Column) -> Column:
    """Trimmed parts between empty lines, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def title_of(name: Column) -> Column:
    """A file's stem with blanks for _ and -, each word capitalised."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def without_tag(text: Column, tag: str) -> Column:
    """Text without <tag>...</tag>, white space made single."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", ""), r"\s+", " "))


def tag_references(code: Column) -> Column:
    """Sorted different tags that screen code names."""
    found = F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in TAG_PATTERNS])
    return F.sort_array(F.array_distinct(F.transform(found, lambda x: F.trim(x))))


def navigation_targets(code: Column) -> Column:
    """Targets of screen changes in order, with repeats."""
    return F.regexp_extract_all(code, F.lit(NAVIGATION_PATTERN), F.lit(1))


def event_type(function: Column) -> Column:
    out = F.lit("unknown")
    for suffix, label in reversed(EVENT_SUFFIXES.items()):
        out = F.when(F.contains(function, F.lit(suffix)), label).otherwise(out)
    return out


def screen_name(strings: Column, skip: tuple[str, ...] = NO_SCREEN_NAMES) -> Column:
    """The first string that looks like a screen's name: upper case first, else mixed case; null where none does."""
    quiet = lambda s: ~F.exists(F.array(*map(F.lit, skip)), lambda k: F.contains(F.upper(s), k)) if skip else F.lit(True)
    strict = F.filter(strings, lambda s: quiet(s) & F.rlike(s, F.lit("^[A-Z0-9][A-Z0-9_ ]{2,}$")) & (F.length(s) < 60))
    loose = F.filter(strings, lambda s: quiet(s) & F.rlike(s, F.lit("^[A-Za-z][A-Za-z0-9_ ]{2,}$")))
    return F.coalesce(F.try_element_at(strict, F.lit(1)), F.try_element_at(loose, F.lit(1)))


def address(area: Column, number: Column, bit: Column) -> Column:
    """%DB5.DBX8.3 in a data block, %I0.0 elsewhere; the offset is in bits."""
    byte, rest = F.floor(bit / 8).cast("long"), (bit % 8).cast("long")
    at = F.concat(byte.cast("string"), F.lit("."), rest.cast("string"))
    return F.when(area == "DB", F.concat(F.lit("%DB"), number.cast("string"), F.lit(".DBX"), at)).otherwise(F.concat(F.lit("%"), area, at))


def calls(references: Column) -> Column:
    """Sorted different names behind CALL: in raw references."""
    mine = F.filter(references, lambda r: F.startswith(r, F.lit("CALL:")))
    return F.sort_array(F.array_distinct(F.transform(mine, lambda r: F.substring(r, 6, 1 << 30))))


def tags(references: Column) -> Column:
    """Sorted different references that are no calls."""
    return F.sort_array(F.array_distinct(F.filter(references, lambda r: ~F.startswith(r, F.lit("CALL:")))))


def best_code(code: Column, networks: Column) -> Column:
    """A block's code, or its networks under headings where it has none."""
    headed = F.transform(networks, lambda x, i: F.concat(F.lit("// Network "), (i + 1).cast("string"), F.lit("\n"), x))
    return F.coalesce(F.when(F.trim(code) != "", code), F.array_join(headed, "\n\n"))


def original_names(files: Column) -> Column:
    """Names of stored files: addresses go, images keep their path, others lose what stands before the first dash."""
    kept = F.filter(files, lambda f: ~F.rlike(f, F.lit("^https?://")))
    name = lambda f: F.regexp_replace(F.regexp_replace(f, r"^.*/", ""), r"^[^-]*-", "")
    return F.transform(kept, lambda f: F.when(file_type(f) == "image", f).otherwise(name(f)))


def file_type(path: Column) -> Column:
    """By suffix, as it is written."""
    suffix = F.regexp_extract(path, r"\.([^./]*)$", 1)
    return F.when(suffix.isin(*IMAGE_SUFFIXES), "image").otherwise("document")


def chat_error(content: Column) -> Column:
    """What stands between error marks; null without them."""
    m = F.regexp_extract(content, r"(?s)<chat-error>(.*?)</chat-error>", 1)
    return F.when(F.contains(content, F.lit("<chat-error>")) & F.contains(content, F.lit("</chat-error>")), m)


def decode_files(files: Column) -> Column:
    """JSON text of file names; an empty text is no files."""
    return F.from_json(F.nullif(files, F.lit("")), "array<string>")


def capped(text: Column, limit: int, note: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note))).otherwise(text)
