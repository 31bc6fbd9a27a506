"""Text functions on columns, built-in expressions only.

White space is Unicode white space throughout; nulls give nulls unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stay in lower case inside a title.
PARTICLES = ("DE", "DEL", "LA", "LOS", "LAS", "Y", "E")
# Words that stay in lower case inside a sentence in title case.
CONNECTORS = (*PARTICLES, "A", "EL", "EN", "QUE", "POR", "PARA", "CON", "SU", "SUS", "AL", "UN", "UNA", "UNOS", "UNAS", "SOBRE", "ENTRE", "SE", "NO", "LO", "COMO", "SIN", "TRAS")


def _fold_table() -> tuple[str, str]:
    """Letters of Latin-1, Extended-A and Extended Additional that decompose to a base letter and marks."""
    pairs = []
    for code in (*range(0xC0, 0x180), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()


def fold(c: Column) -> Column:
    """Without accents; ñ becomes n."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def strip(c: Column, also: str = "") -> Column:
    """Without white space, and the given characters, at both ends."""
    edge = rf"(?U)[\s{also}]+"
    return F.regexp_replace(F.regexp_replace(c, "^" + edge, ""), edge + "$", "")


def squash(c: Column) -> Column:
    """One space for each run of white space, none at the ends, null as empty."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def blank_to(c: Column, default: str | None) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def words(c: Column) -> Column:
    """Words between white space; none for null or blank."""
    return F.filter(F.split(squash(c), " "), lambda w: w != "")


def folded_upper(c: Column) -> Column:
    return squash(F.upper(fold(c)))


def body_key(c: Column) -> Column:
    """Key of a committee: letters, digits, spaces and commas, without a leading DE."""
    plain = F.regexp_replace(folded_upper(c), "^DE ", "")
    return squash(F.regexp_replace(plain, "[^A-Z0-9, ]", ""))


def roster_key(c: Column) -> Column:
    """Key of a committee in rosters: without a leading DE and its article."""
    return squash(F.regexp_replace(folded_upper(c), "^DE( (LA|LOS|LAS|EL))? ", ""))


def surname_key(c: Column) -> Column:
    return folded_upper(c)


def person_key(c: Column, collapse: bool = True) -> Column:
    """SURNAME, NAMES: both parts of the first comma trimmed, upper case; inner runs of
    white space become one space unless collapse is off."""
    parts = F.split(F.coalesce(c, F.lit("")), ",", 2)
    clean = squash if collapse else strip
    return F.upper(F.array_join(F.transform(parts, lambda p: clean(p)), ", "))


def capitalised(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def title_particles(c: Column) -> Column:
    """Each word capitalised, particles in lower case unless first."""
    return F.array_join(F.transform(words(c), lambda w, i: F.when(F.upper(w).isin(*PARTICLES) & (i > 0), F.lower(w)).otherwise(capitalised(w))), " ")


def first_letter_upper(w: Column) -> Column:
    """The first letter in upper case, the rest as it is; ordinals such as 8va stay."""
    before = F.regexp_extract(w, r"^([^\p{L}]*)", 1)
    at = F.length(before) + 1
    raised = F.concat(before, F.upper(F.substring(w, at, F.lit(1))), F.substring(w, at + 1, F.length(w)))
    return F.when(w.rlike(r"^\d+[a-zñ]{1,3}$"), w).otherwise(raised)


def sentence_case(c: Column) -> Column:
    """Title case with connectors in lower case but at the start of a sentence."""
    found = F.split(F.lower(strip(c)), " ")
    key = lambda w: F.upper(fold(F.regexp_replace(w, r"(?U)[^\w]", "")))
    starts = lambda i: (i == 0) | F.coalesce(F.get(found, i - 1).rlike(r"[.!?]\s*$"), F.lit(True))
    return F.array_join(F.transform(found, lambda w, i: F.when(starts(i) | ((key(w) != "") & ~key(w).isin(*CONNECTORS)), first_letter_upper(w)).otherwise(w)), " ")


def title_each(c: Column) -> Column:
    """Upper case after anything that isn't a letter, lower case elsewhere."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, capitalised), "")


def surname_first(c: Column) -> Column:
    """'Given Names SURNAME WORDS' to 'SURNAME WORDS, Given Names'. The surname is the
    longest run of upper-case words at the end, the last word, as it is spelt, if there is none."""
    w = words(c)
    is_upper = lambda x: F.upper(x) == x
    letters = lambda x: x.rlike(r"\p{L}")
    tail = F.aggregate(F.reverse(w), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.when(a["go"] & is_upper(x) & letters(x), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("go"))), lambda a: a["n"])
    n = F.greatest(F.lit(1), tail)
    surname = F.array_join(F.slice(w, F.size(w) - n + 1, n), " ")
    given = title_each(F.array_join(F.slice(w, F.lit(1), F.size(w) - n), " "))
    return F.when(F.size(w) == 0, "").when(given == "", surname).otherwise(F.concat_ws(", ", surname, given))


def referrals(c: Column) -> Column:
    """Parts between ' - ', in title case, each once, in order of appearance."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), " - "), lambda p: strip(p, "-"))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), title_particles))


def dash_parts(c: Column) -> Column:
    """Words of a cell without one dash at its end."""
    return words(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "-$", ""))


def author_list(c: Column) -> Column:
    """Names between ' - ' as person keys, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), " - "), lambda p: strip(F.regexp_replace(strip(p), "-$", "")))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: person_key(p, collapse=False))


def after_colon(c: Column) -> Column:
    """What follows the first colon, all without one."""
    parts = F.split(c, ":", 2)
    return strip(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))


def contained(a: Column, b: Column) -> Column:
    """Whether either text contains the other. An empty text is in any."""
    return F.contains(a, b) | F.contains(b, a)


def without_author_prefix(title: Column, authors: Column) -> Column:
    """title without what stands before its first colon, if all surnames there match an author."""
    parts = F.split(title, ":", 2)
    names = F.filter(F.transform(F.split(F.get(parts, F.lit(0)), r"(?U),|\s+[Yy]\s+"), folded_upper), lambda n: (n != "") & ~n.isin("OTRO", "OTROS", "OTRA", "OTRAS"))
    known = F.transform(authors, lambda a: folded_upper(F.get(F.split(a, ","), F.lit(0))))
    all_known = (F.size(names) > 0) & F.forall(names, lambda n: F.exists(known, lambda k: contained(n, k)))
    return F.when((F.size(parts) == 2) & all_known, strip(F.get(parts, F.lit(1)))).otherwise(strip(title))


def main_authors(title: Column, authors: Column) -> Column:
    """struct(main, others): where the title says 'Y OTRO(S)' before its first colon, or
    anywhere without one, authors named there are main, else all; the first one if it names none."""
    before = F.upper(F.get(F.split(title, ":", 2), F.lit(0)))
    some = r"(?U)\s*\bY\s+OTR[OA]S?\b"
    names = F.filter(F.transform(F.split(F.regexp_replace(before, some, ""), r"(?U),\s*|\s+Y\s+"), lambda p: strip(p)), lambda p: p != "")
    surname = lambda a: F.upper(strip(F.get(F.split(a, ","), F.lit(0))))
    named = F.filter(authors, lambda a: F.exists(names, lambda p: contained(p, surname(a))))
    main = F.when(~before.rlike(some), authors).when(F.size(named) > 0, named).otherwise(F.slice(authors, 1, 1))
    return F.struct(main.alias("main"), F.array_except(authors, main).alias("others"))


def extract_parts(c: Column) -> Column:
    """struct(author, description): a colon at character 2 to 61 splits them, unless the text is a message."""
    at, text = F.locate(":", c), strip(c)
    splits = ~F.upper(text).startswith("MENSAJE") & at.between(2, 61)
    return F.struct(F.when(splits, strip(F.substring(c, F.lit(1), at - 1))).otherwise("").alias("author"), F.when(splits, strip(F.substring(c, at + 1, F.length(c)))).otherwise(text).alias("description"))


def record_url(base: str, number: Column, year: Column, origin: Column, kind: Column) -> Column:
    """base/number.yy/origin/kind."""
    return F.concat(F.lit(base + "/"), number.cast("string"), F.lit("."), F.right(year.cast("string"), F.lit(2)), F.lit("/"), origin, F.lit("/"), kind)


def signers(c: Column) -> Column:
    """Names between spaced hyphens or dashes, without final stops."""
    return F.filter(F.transform(F.split(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+[–-]\s+"), lambda p: strip(F.regexp_replace(strip(p), r"\.+$", ""))), lambda p: p != "")


def labelled(code: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """The label of a code, else default, else the code."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code if default is None else default)


def code_kind(c: Column) -> Column:
    """The two-letter type at the end of a case code such as PE-231/26-AC, empty without one."""
    return F.regexp_extract(F.upper(strip(F.coalesce(c, F.lit("")))), r"^[A-Z.]+-\d+/\d+-([A-Z]{2})$", 1)


def code_origin(c: Column, labels: dict[str, str]) -> Column:
    """The label of a case code's origin, dots dropped; unknown ones in title case."""
    prefix = F.regexp_replace(F.regexp_extract(F.upper(strip(c)), r"^([A-Z.]+)-", 1), r"\.", "")
    return labelled(prefix, labels, title_each(prefix))


def canonical_code(c: Column) -> Column:
    """A case code that joins across sources: upper case, no dots or spaces, one hyphen after the origin."""
    bare = F.regexp_replace(F.upper(c), r"(?U)[\s.]", "")
    return F.regexp_replace(bare, r"^([A-ZÑ]+)-?(\d)", "$1-$2")
