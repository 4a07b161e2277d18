"""Values as canonical JSON text, and the predicates and formats on them.

A cell is one nullable string column: SQL NULL is an absent field, ``null`` an explicit JSON
null, everything else the JSON text of the value with sorted object keys and numbers as
JavaScript prints them. All builders stay inside whole-stage code generation; only Unicode
normalisation and URL re-serialisation (P4) need Python, behind a guard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space that JavaScript's trim() strips (fixed value), as text and as a character class.
JS_BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
JS_BLANK = f"[{JS_BLANKS}]"
#: Placeholder texts that count as empty.
PLACEHOLDERS = ("", "n/a", "na", "none", "unknown", "-")
NULL_JSON = "null"


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(JS_BLANKS))


def json_of(value: Column, numeric: bool = False) -> Column:
    """JSON text of a typed column (table mode); SQL NULL becomes ``null``. ``numeric``: integral doubles lose their fraction."""
    inner = F.to_json(F.array(value))
    out = F.substring(inner, F.lit(2), F.length(inner) - 2)
    return F.regexp_replace(out, r"\.0(?=$|E)", "") if numeric else out


def json_of_variant(value: Column) -> Column:
    """JSON text of a variant (record mode): keys sorted, numbers outside strings without a zero fraction."""
    return F.regexp_replace(F.to_json(value), r"^(-?[0-9].*)\.0$", "$1")  # one mention of the value, which is rendered once


def is_string(json: Column) -> Column:
    return json.startswith('"')


def string_of(json: Column) -> Column:
    """The text of a JSON string, NULL for other values; escapes are undone only where there are any."""
    plain = F.substring(json, F.lit(2), F.length(json) - 2)
    return F.when(is_string(json), F.when(json.contains("\\"), F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), F.lit(0))).otherwise(plain))


def text_of(json: Column) -> Column:
    """Strings as they are, other values as JSON text."""
    return F.coalesce(string_of(json), json)


def kind_of(json: Column) -> Column:
    """``string``, ``number``, ``boolean``, ``array`` or ``object`` (null counts as object); NULL if absent."""
    first = F.substring(json, 1, 1)
    return (
        F.when(json.isNull(), None)
        .when(first == '"', "string")
        .when(first == "[", "array")
        .when(first.isin("{", "n"), "object")
        .when(first.isin("t", "f"), "boolean")
        .otherwise("number")
    )


def is_blank(json: Column) -> Column:
    """Absent, null or white space only."""
    return json.isNull() | (json == NULL_JSON) | (F.coalesce(js_trim(string_of(json)), F.lit("x")) == "")


def is_empty(json: Column, placeholders: Sequence[str] = (), allow_empty_array: bool = False) -> Column:
    """Absent, null, blank, a placeholder (lower-cased), or an empty array. Own placeholders are compared as given."""
    text = F.lower(js_trim(string_of(json)))
    out = json.isNull() | (json == NULL_JSON) | F.coalesce(text.isin(*PLACEHOLDERS, *placeholders), F.lit(False))
    return out if allow_empty_array else out | (json == "[]")


def same_value(a: Column, b: Column) -> Column:
    """Equality of canonical values; absent equals absent."""
    return a.eqNullSafe(b)


@F.pandas_udf(StringType())
def _normalised(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata
    from urllib.parse import quote, urlsplit

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        text = unicodedata.normalize("NFC", text)
        if text[:7].lower() != "http://" and text[:8].lower() != "https://":
            return text
        try:
            u = urlsplit(text)
            port = u.port
            host = (u.hostname or "").encode("idna").decode() if not (u.hostname or "").isascii() else u.hostname or ""
        except ValueError:
            return text
        if not host or " " in host:
            return text
        who = f"{u.username}{':' + u.password if u.password else ''}@" if u.username else ""
        port_text = "" if port is None or port == {"http": 80, "https": 443}[u.scheme] else f":{port}"
        safe = "!$&'()*+,;=:@/%-._~|[]\\^`{}"
        out = f"{u.scheme}://{who}{host}{port_text}{quote(u.path or '/', safe=safe)}"
        return out + (f"?{quote(u.query, safe=safe + '?')}" if u.query else "") + (f"#{quote(u.fragment, safe=safe + '?')}" if u.fragment else "")

    for texts in parts:
        yield texts.map(one, na_action="ignore")


def identity_value(json: Column, normalise: bool = True) -> Column:
    """Trimmed text of a scalar, NFC, http(s) URLs re-serialised; NULL for absent, null, blank, arrays and objects.

    Python is reached only by URLs and non-ASCII texts; ``normalise=False`` leaves it out of
    the plan for keys that hold neither (codes and numbers).
    """
    text = F.when(~kind_of(json).isin("array", "object"), js_trim(text_of(json)))
    text = F.when(text != "", text)
    if not normalise:
        return text
    odd = text.rlike(r"^(?i)https?://") | text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _normalised(F.when(odd, text))).otherwise(text)


def json_list(*texts: Column) -> Column:
    """``JSON.stringify`` of a list of strings; a NULL stands as null."""
    return F.to_json(F.array(*texts))


def identity_key(values: Sequence[Column]) -> Column:
    """P5: JSON list of the components, NULL if any is NULL or there is none."""
    if not values:
        return F.lit(None).cast("string")
    whole = values[0].isNotNull()
    for v in values[1:]:
        whole = whole & v.isNotNull()
    return F.when(whole, json_list(*values))


def record_label(values: Sequence[Column]) -> Column:
    """P6."""
    return F.concat_ws("::", *[F.coalesce(v, F.lit("?")) for v in values])


def change_kind(before: Column, after: Column, placeholders: Sequence[str] = (), allow_empty_array: bool = False) -> Column:
    """NULL where nothing changed."""
    b, a = (is_empty(x, placeholders, allow_empty_array) for x in (before, after))
    return (
        F.when(same_value(before, after), None)
        .when(before.isNull(), "added")
        .when(after.isNull(), "removed")
        .when(~b & a, "emptied")
        .when(b & ~a, "restored")
        .otherwise("modified")
    )


DATE_FORMATS = ("M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy/M/d")


def parse_date(text: Column) -> Column:
    """A timestamp by ISO 8601 or one of DATE_FORMATS (frozen list), else NULL."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def failure(text: Column, rule: str) -> Column:
    """NULL if the text is valid, else a reason. Rules: json, url, date, email, phone."""
    t = js_trim(text)
    if rule == "json":
        return F.when(F.try_parse_json(text).isNull(), "not parseable as JSON")
    if rule == "url":
        return F.when(~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "not an absolute URL").when(~t.rlike(r"^(?i)https?:"), F.concat(F.lit('scheme "'), F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)), F.lit('" is not http or https'))).when(~t.rlike(r"^(?i)https?:/*[^/\s?#]+"), "not an absolute URL")
    if rule == "date":
        return F.when(parse_date(t).isNull(), "not parseable as a date")
    if rule == "email":
        parts = F.split(t, "@")
        good = (F.size(parts) == 2) & (F.length(F.get(parts, F.lit(0))) > 0) & F.get(parts, F.lit(1)).contains(".")
        return F.when(~good | t.rlike(r"\s"), "not shaped like an email address")
    if rule == "phone":
        return F.when(F.regexp_replace(text, r"\D", "") == "", "contains no digits")
    raise ValueError(f"unknown validation rule {rule!r}")


def validation_severity(rule: str, required: bool) -> str:
    """P10."""
    return "low" if rule in ("email", "phone") else "high" if required else "medium"


def fnv1a32(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, as eight hexadecimal digits. In ASCII texts characters are units."""
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))
    first = F.lit(0x811C9DC5).cast("long")
    plain = F.aggregate(F.split(text, ""), first, lambda h, c: F.when(c == "", h).otherwise(step(h, F.ascii(c).cast("long"))))
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.when(F.length(raw) >= 4, F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    total = F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.aggregate(units, first, step))
    return F.lpad(F.lower(F.hex(total)), 8, "0")


def finding_id(category: Column, key: Column, field: Column, discriminator: Column) -> Column:
    """P12."""
    return F.concat(category, F.lit(":"), fnv1a32(json_list(category, key, field, discriminator)))


def csv_capped(t: Column, cap: int = 500) -> Column:
    return F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap), F.lit("…[truncated "), (F.length(t) - cap).cast("string"), F.lit(" chars]"))).otherwise(t)


def csv_defused(t: Column) -> Column:
    return F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)


def csv_quoted(t: Column) -> Column:
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_cell(text: Column, cap: int = 500) -> Column:
    """Capped, formulas defused, quoted where needed; NULL is the empty cell."""
    return csv_quoted(csv_defused(csv_capped(F.coalesce(text, F.lit("")), cap)))


def cell_text(json: Column) -> Column:
    """P16."""
    return F.when(json.isNull(), "(absent)").when(json == NULL_JSON, "(null)").when(is_blank(json), "(blank)").otherwise(text_of(json))


def evidence_text(json: Column, cap: int = 120) -> Column:
    """P20: white space collapsed, capped."""
    t = js_trim(F.regexp_replace(text_of(json), f"{JS_BLANK}+", " "))
    t = F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap - 1), F.lit("…"))).otherwise(t)
    return F.when(json.isNull() | (json == NULL_JSON), "(absent)").when(is_blank(json), "(blank)").otherwise(t)


def natural_key(text: Column, width: int = 20) -> Column:
    """Sort key for numeric-aware, case-blind order: runs of digits are padded to ``width``."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def slug(text: Column) -> Column:
    """P19."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def percent_text(rate: Column, digits: int = 1) -> Column:
    """P22."""
    return F.concat(F.format_number(rate * 100, digits), F.lit("%"))


#: A key in JSON text that names a secret and so refuses an export (P21; fixed value).
SECRET_KEY = r'(?i)"(?:[^"]*(?:token|secret|password|passwd|api[-_]?key|authorization|credential)[^"]*)"\s*:'
