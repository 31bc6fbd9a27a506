"""HTML as column expressions: character references, attributes, elements that nest.

Elements follow the reading of a lenient parser: an end tag closes what was opened last
under its name and all that was opened since, one without a start is ignored, and what
is left open ends with the text. Comments, scripts and styles aren't content.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_TAGS = ("table", "tr", "td", "th")
#: The rest of a tag: a mark of its end may stand in quotes.
_REST = r"""\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ANY_TAG = r"""</?[A-Za-z!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
#: Names that count without a semicolon, the longest first, and all others.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NAMES = json.dumps(html5, ensure_ascii=True)
_MAX_CODE, _REPLACED = 0x10FFFF, "�"
#: Codes from 128 to 159 stand for the characters that Windows has there.
_WINDOWS = json.dumps({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)})


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def every(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _character(code: Column) -> Column:
    """The character of a code; of one that no character has, the replacement; nothing for a control."""
    windows = F.element_at(F.from_json(F.lit(_WINDOWS), "map<string,string>"), code.cast("string"))
    shown = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    wrong = code.isNull() | (code > _MAX_CODE) | (code == 0) | code.between(0xD800, 0xDFFF)
    control = code.between(1, 8) | code.isin(11, 127) | code.between(14, 31) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return F.when(wrong, _REPLACED).when(code.between(128, 159), windows).when(control, "").otherwise(shown)


def decoded(c: Column, attribute: bool = False) -> Column:
    """Text with named and numeric character references resolved. A name without its
    semicolon counts if it is one of the old ones; in an attribute only if no letter,
    digit or equals sign follows."""
    end = "(?![A-Za-z0-9=])" if attribute else ""
    bare = f"&(?:{_BARE}){end}"
    parts = every(c, rf"(?s)(&\#[0-9]+;?|&\#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;|{bare}|[^&]+|&)")
    digits = lambda p: F.regexp_extract(p, "[0-9A-Fa-f]+", 0)
    number = lambda p: F.when(F.length(digits(F.substring(p, 3, 99))) > 9, F.lit(None).cast("long")).otherwise(F.when(p.rlike("^&#[xX]"), F.conv(digits(p), 16, 10)).otherwise(digits(p)).try_cast("long"))
    name = lambda p: F.element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), p)
    old = lambda p: F.regexp_extract(p, f"^&({_BARE})", 1)
    named = lambda p: F.coalesce(name(F.substring(p, F.lit(2), F.length(p))), F.when(F.lit(not attribute) & (old(p) != ""), F.concat(name(old(p)), F.substring(p, F.length(old(p)) + 2, F.length(p)))), p)
    one = lambda p: F.when(p.startswith("&#") & (F.length(p) > 2), let(number(p), _character)).when(p.rlike("^&[A-Za-z]"), named(p)).otherwise(p)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def content(html: Column) -> Column:
    """Without comments, scripts and styles."""
    return F.regexp_replace(html, _HIDDEN, "")


def tag_text(html: Column) -> Column:
    """A space for each tag; references stay."""
    return F.regexp_replace(content(html), f"(?s){_ANY_TAG}", " ")


def texts(html: Column) -> Column:
    """The texts between tags, references resolved."""
    return F.transform(F.split(content(html), f"(?s){_ANY_TAG}"), lambda x: decoded(x))


def attribute(tag: Column, name: str) -> Column:
    """The value of a start tag's attribute, in quotes of either kind or none; null without it."""
    pattern = rf"""(?is)^<[a-z0-9]+(?:[^>"']|"[^"]*"|'[^']*')*?(?<=[\s"'/]){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
    bare = lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return let(F.regexp_extract(tag, pattern, 1), lambda v: F.when(v != "", decoded(bare(v), attribute=True)))


def hrefs(html: Column, wanted: str = "") -> Column:
    """The targets of links whose href has a pattern, in order."""
    found = F.transform(every(content(html), f"(?is)(<a{_REST})"), lambda a: attribute(a, "href"))
    return F.filter(found, lambda h: h.isNotNull() & (h.rlike(wanted) if wanted else F.lit(True)))


_OPEN = "struct<rank:int,name:string,at:int>"
_DONE = "struct<rank:int,name:string,at:int,close:int,next:int>"


def elements(html: Column, names: tuple[str, ...] = TABLE_TAGS) -> Column:
    """array<struct<rank, next, name, tag, inner>>: elements of the names in the order of
    their start tags. Those within one are from its rank + 1 to before its next."""
    tag = f"(?is)</?(?:{'|'.join(names)}){_REST}"

    def nested(page: Column) -> Column:
        kinds = F.transform(
            page["tags"],
            lambda t, i: F.struct(i.alias("at"), F.lower(F.regexp_extract(t, "^</?([A-Za-z0-9]+)", 1)).alias("name"), t.startswith("</").alias("ends"), t.rlike(r"/\s*>$").alias("alone")),
        )
        start = F.struct(F.array().cast(f"array<{_OPEN}>").alias("open"), F.array().cast(f"array<{_DONE}>").alias("done"), F.lit(0).alias("n"))
        closed = lambda opened, at, n: F.transform(opened, lambda o: F.struct(o["rank"], o["name"], o["at"], at.alias("close"), n.alias("next")))

        def step(s: Column, k: Column) -> Column:
            size = F.size(s["open"])
            # From its end, the last one opened under the name.
            back = F.array_position(F.reverse(F.transform(s["open"], lambda o: o["name"])), k["name"]).cast("int")
            return let(F.when(k["ends"], F.when(back == 0, size).otherwise(size - back)), lambda keep: after(s, k, size, keep))

        def after(s: Column, k: Column, size: Column, keep: Column) -> Column:
            gone = F.slice(s["open"], keep + 1, size - keep)
            alone = F.array(F.struct(s["n"].alias("rank"), k["name"].alias("name"), k["at"].alias("at"), k["at"].alias("close"), (s["n"] + 1).alias("next")))
            own = F.array(F.struct(s["n"].alias("rank"), k["name"].alias("name"), k["at"].alias("at")))
            ended = F.struct(F.slice(s["open"], F.lit(1), keep).alias("open"), F.concat(s["done"], closed(gone, k["at"], s["n"])).alias("done"), s["n"].alias("n"))
            single = F.struct(s["open"].alias("open"), F.concat(s["done"], alone).alias("done"), (s["n"] + 1).alias("n"))
            opened = F.struct(F.concat(s["open"], own).alias("open"), s["done"].alias("done"), (s["n"] + 1).alias("n"))
            return F.when(k["ends"], ended).when(k["alone"], single).otherwise(opened)

        found = F.aggregate(kinds, start, step, lambda s: F.array_sort(F.concat(s["done"], closed(s["open"], F.size(page["tags"]), s["n"]))))
        # Texts and tags in turn: the text after tag i is item 2 * i + 2, counted from 0.
        flat = F.flatten(F.zip_with(page["texts"], page["tags"], lambda x, t: F.filter(F.array(x, t), lambda y: y.isNotNull())))
        inner = lambda flat, e: F.when(e["close"] > e["at"], F.array_join(F.slice(flat, 2 * e["at"] + 3, 2 * (e["close"] - e["at"]) - 1), "")).otherwise("")
        shown = lambda p: F.transform(p["found"], lambda e: F.struct(e["rank"], e["next"], e["name"], F.get(page["tags"], e["at"]).alias("tag"), inner(p["flat"], e).alias("inner")))
        return let(F.struct(found.alias("found"), flat.alias("flat")), shown)

    scan = lambda c: let(F.struct(every(c, f"({tag})").alias("tags"), F.split(c, tag).alias("texts")), nested)
    return let(content(html), scan)


def within(found: Column, e: Column, *names: str) -> Column:
    """Of elements those of the names within one of them, at any depth."""
    return F.filter(F.slice(found, e["rank"] + 2, e["next"] - e["rank"] - 1), lambda x: x["name"].isin(*names))


def named(found: Column, *names: str) -> Column:
    return F.filter(found, lambda x: x["name"].isin(*names))
