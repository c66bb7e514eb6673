"""Column functions over M text: comment and string masking, redaction, caps.

All are built-in expressions, linear in the text length, and whole-text: no
prefix is taken before masking or matching.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import fixed_values as fv

# Every character of the text falls in exactly one token: a string literal
# ("" is an escaped quote; an unclosed one runs to the end), a line comment, a
# block comment (an unclosed one runs to the end), other text, or a lone slash.
_TOKEN = r'"[^"]*+(?:""[^"]*+)*+"?|//[^\n]*+|(?s:/\*.*?(?:\*/|\z))|[^"/]++|/'

# Parentheses inside string literals stand in as two code points that Unicode
# reserves for internal use, so that structure can be matched on the text and
# the literal read back afterwards.
HIDDEN = "\ufdd0\ufdd1"

_KV_SECRET = rf"(?iUd)\b({fv.SECRET_KEYS})\s*=\s*(\"[^\"]*\"|'[^']*'|[^;\s]+)"
_SHARED_SECRET = rf"(?iUd)\b(shared\s+(?:{fv.SECRET_KEYS})[A-Za-z0-9_]*)\s*=\s*\"([^\"]+)\""


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _blank(token: Column) -> Column:
    return F.repeat(F.lit(" "), F.length(token))


def _is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def _rewrite(text: Column, on_string) -> Column:
    return F.array_join(
        F.transform(
            _tokens(text),
            lambda t: F.when(_is_comment(t), _blank(t))
            .when(t.startswith('"'), on_string(t))
            .otherwise(t),
        ),
        "",
    )


def mask_comments(text: Column) -> Column:
    """Comments become spaces of equal length; string literals stay."""
    return F.when(text.contains("/"), _rewrite(text, lambda t: t)).otherwise(text)


def mask_strings(text: Column) -> Column:
    """Comments and string literals become spaces of equal length."""
    return F.when(text.rlike('["/]'), _rewrite(text, _blank)).otherwise(text)


def hide_strings(text: Column) -> Column:
    """Comments blanked, parentheses inside string literals hidden."""
    return F.when(
        text.rlike('["/]'), _rewrite(text, lambda t: F.translate(t, "()", HIDDEN))
    ).otherwise(text)


def reveal_strings(text: Column) -> Column:
    """Undo the hiding of ``hide_strings``."""
    return F.translate(text, HIDDEN, "()")


def redact_secrets(text: Column) -> Column:
    """Secret values of key=value pairs, shared parameters and JWTs are replaced."""
    kv = F.regexp_replace(text, _KV_SECRET, f"$1={fv.REDACTED}")
    shared = F.regexp_replace(kv, _SHARED_SECRET, f'$1 = "{fv.REDACTED}"')
    return F.regexp_replace(shared, "(?U)" + fv.JWT_PATTERN, fv.REDACTED)


def truncate_marked(text: Column, cap: int) -> Column:
    """Text over the cap keeps its first ``cap`` characters and gets a marker."""
    return F.regexp_replace(text, rf"(?s)\A(.{{{cap}}}).+\z", f"$1{fv.TRUNCATION_MARK}")


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def looks_like_m(text: Column) -> Column:
    return F.coalesce(
        (F.length(text) >= 4)
        & (text.contains("let ") | text.contains("Source") | text.contains("shared ")),
        F.lit(False),
    )


def safe_key(name: Column) -> Column:
    """Letters, digits and underscores stay; anything else becomes ``_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")


def non_empty(text: Column) -> Column:
    """Empty text reads as NULL."""
    return F.nullif(text, F.lit(""))


def identity_hash(value: Column, trim: bool = False) -> Column:
    """First 12 hex digits of SHA-256; an empty id stays empty."""
    hashed = strip(value) if trim else value
    return F.when(
        F.coalesce(value, F.lit("")) == "", F.lit("")
    ).otherwise(F.substring(F.sha2(hashed, 256), 1, 12))


def base64_alphabet(payload: Column) -> Column:
    """Only the characters base64 uses; stray ones are ignored when decoding."""
    return F.regexp_replace(F.coalesce(payload, F.lit("")), "[^A-Za-z0-9+/=]", "")


def decode_base64(kept: Column) -> Column:
    """Base64 text to UTF-8 text; bad base64 gives '', bad bytes give U+FFFD."""
    decoded = F.make_valid_utf8(F.try_to_binary(kept, F.lit("base64")).cast("string"))
    return F.when(F.length(kept) % 4 == 0, F.coalesce(decoded, F.lit(""))).otherwise("")


# --- JSON -------------------------------------------------------------------------

# Spark's JSON reader gives NULL for a document with a longer string, number or nesting than its defaults.
WHOLE_JSON = {"maxStringLen": "2147483647", "maxNumLen": "2147483647", "maxNestingDepth": "2147483647"}
# A VARIANT is built by recursion, a few stack frames per level: what nests deeper than this is not read into one.
VARIANT_DEPTH = 1500


def read_json(text: Column, schema: str) -> Column:
    """from_json without length limits; invalid JSON is NULL, and so is what nests too deeply for a VARIANT."""
    limit = {"maxNestingDepth": str(VARIANT_DEPTH)} if "variant" in schema.lower() else {}
    return F.from_json(text, schema, {**WHOLE_JSON, **limit})


def is_too_deep(text: Column) -> Column:
    """Valid JSON that ``read_json`` does not read into a VARIANT."""
    may_be = F.regexp_count(text, F.lit(r"[\[{]")) > VARIANT_DEPTH
    as_rows = F.from_json(text, "_bad STRING", {**WHOLE_JSON, "columnNameOfCorruptRecord": "_bad"})
    return F.when(may_be, read_json(text, "variant").isNull() & as_rows["_bad"].isNull()).otherwise(False)
