r"""Text functions as Spark columns.

White space is the class below everywhere; Spark's ``\s`` and ``trim`` know
fewer characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.config import SNIPPET_CHARS

#: Fixed values of the accepted syntax: white space, the same without the line feed, headings, YAML lines and frontmatter.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_IN_LINE = WS.replace(r"\n", "")
_NOT_WS = WS.replace("[", "[^", 1)
_HEADING = rf"#{{1,6}}{WS_IN_LINE}+[^\n\r\u2028\u2029]*"
_YAML_LINE = rf"^(?:{WS}*#|{WS}*-{WS}|{WS}+{_NOT_WS}|[A-Za-z0-9_.$-]+{WS}*:)"
_FENCE = r"^(---\r?\n((?:[\s\S]*?\r?\n)?)---\r?\n?)"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once; a plain column would be repeated wherever f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def spaced(c: Column) -> Column:
    """White space as single spaces, none at the ends: the tokens of a text between spaces."""

    def flat(x: Column) -> Column:
        # a single space before anything else stays as it is; most characters are told by the first test
        runs = F.regexp_replace(x, f"(?![!-~])(?: {WS}|{WS.replace(' ', '', 1)}){WS}*", " ")
        odd = x.contains("  ") | x.contains("\t") | x.contains("\x0b") | x.contains("\f") | x.contains("\r")
        return F.when(odd | ((F.octet_length(x) > F.length(x)) & x.rlike(f"(?=[^\\x00-\\x7F]){WS}")), runs).otherwise(x)

    # in most texts line feeds are all that must go, and looking for single strings takes a tenth of what an expression does
    return F.btrim(bound(F.replace(c, F.lit("\n"), F.lit(" ")), flat))


def tokens(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, WS + "+"), lambda x: x != "")


def terms(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def without_frontmatter(c: Column) -> Column:
    """Drops a leading fenced block if each of its non-blank lines looks like YAML."""
    fence = F.regexp_extract(c, _FENCE, 1)
    inner = F.filter(F.split(F.regexp_extract(c, _FENCE, 2), "\r?\n"), lambda line: trimmed(line) != "")
    return F.when((fence != "") & F.forall(inner, lambda line: line.rlike(_YAML_LINE)), F.substring(c, F.length(fence) + 1, F.length(c))).otherwise(c)


def sections(body: Column) -> Column:
    """ATX sections, array<struct<heading, body>>: split before each heading line, within the row."""
    # most texts have no heading and are not searched for one
    parts = F.when(body.contains("#"), F.split(body, rf"(?=#)(?<![^\n])(?={_HEADING}(?:\n|\z))", -1)).otherwise(F.array(body))

    def section(part: Column) -> Column:
        line = F.when(part.startswith("#"), F.regexp_extract(part, rf"^{_HEADING}(?:\n|\z)", 0)).otherwise("")
        heading = trimmed(F.regexp_replace(line, rf"^#{{1,6}}{WS_IN_LINE}+", ""))
        return F.struct(heading.alias("heading"), trimmed(F.substring(part, F.length(line) + 1, F.length(part))).alias("body"))

    return F.filter(F.transform(parts, section), lambda s: (s["heading"] != "") | (s["body"] != ""))


def basename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md\z", "")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md\z", "")


def snippet(c: Column, size: int = SNIPPET_CHARS) -> Column:
    flat = spaced(c)
    cut = lambda x: F.when(F.length(x) > size, F.concat(F.regexp_replace(F.substring(x, 1, size), r" +\z", ""), F.lit("…"))).otherwise(x)
    return bound(flat, cut)


def embed_surface(heading: Column, text: Column) -> Column:
    return F.when(F.length(heading) > 0, F.concat(heading, F.lit("\n"), text)).otherwise(text)


def lexical_surface(title: Column, heading: Column, text: Column) -> Column:
    return trimmed(F.concat(title, F.lit(" "), heading, F.lit(" "), text))


def defanged(c: Column) -> Column:
    """Framing tags inside untrusted text lose their brackets."""
    return F.regexp_replace(c, r"(?i)<(/?)(context|conversation)>", "&lt;$1$2&gt;")


def wikilinks(c: Column) -> Column:
    """Names in [[name#part|label]], in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: trimmed(F.substring_index(F.substring_index(x, "|", 1), "#", 1)))


def slug(title: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.regexp_replace(F.substring(dashed, 1, 70), r"-+\z", "")


def yaml_string(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def eval_title(content: Column, name: Column) -> Column:
    """The first quoted title anywhere in a note, else its file name without extension."""
    found = F.regexp_extract(content, rf'title:{WS}*"([^"]+)"', 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(name, r"\.md\z", ""))


#: Fixed values of YAML's core types: plain scalars of these forms are no strings.
_NOT_STRING = r"(?:~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))?"
#: What an escape of a double-quoted scalar stands for.
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", "N": "\u0085", "_": " ", "L": " ", "P": " "}
_COMMENT = r"[ \t]*(?:[ \t]#.*)?\z"
_DOUBLE = rf'(?s)\A"((?:[^"\\]|\\.)*)"{_COMMENT}'
_SINGLE = rf"(?s)\A'((?:[^']|'')*)'{_COMMENT}"


def _unescaped(c: Column) -> Column:
    r"""The inside of a double-quoted scalar: \x41, A (pairs of surrogates side by side) and single letters."""

    def part(x: Column) -> Column:
        hexed = F.when(x.rlike(r"(?s)\A\\x"), F.regexp_replace(x, r"\\x", "00")).otherwise(F.regexp_replace(x, r"\\u", ""))
        one = F.substring(x, 2, 1)
        named = F.lit(None).cast("string")
        for letter, value in _ESCAPES.items():
            named = F.when(one == letter, F.lit(value)).otherwise(named)
        return F.when(~x.startswith("\\"), x).when(x.rlike(r"(?s)\A\\[xu].."), F.decode(F.unhex(hexed), "UTF-16BE")).otherwise(F.coalesce(named, one))

    tokens_ = F.regexp_extract_all(c, F.lit(r"(?s)(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(tokens_, part), "")


def yaml_text(raw: Column) -> Column:
    """The string that a scalar on one line stands for; null for other types, for collections and for what is no scalar."""
    double, single = F.regexp_extract(raw, _DOUBLE, 1), F.regexp_extract(raw, _SINGLE, 1)
    plain = trimmed(F.regexp_replace(raw, r"(?:\A|[ \t])#.*\z", ""))
    # characters that start no plain scalar, and what a mapping inside would need
    odd = plain.rlike(r"""\A(?:[\[\]{},&*!|>%@`"']|[-?:](?:\s|\z))""") | plain.rlike(r":(?:\s|\z)")
    return F.when(raw.rlike(_DOUBLE), _unescaped(double)).when(raw.rlike(_SINGLE), F.replace(single, F.lit("''"), F.lit("'"))).when(~odd & ~plain.rlike(rf"\A{_NOT_STRING}\z"), plain)


def frontmatter_title(content: Column, path: Column) -> Column:
    """The title of the frontmatter block if it is a non-empty string, else the base name; titles of several lines are not read."""
    block = F.regexp_extract(content, _FENCE, 2)
    raw = F.regexp_extract(block, r"(?m)^(?:title|\"title\"|'title')[ \t]*:(?:[ \t]+([^\r\n]*?))?[ \t]*\r?$", 1)
    return F.coalesce(bound(raw, lambda x: F.nullif(yaml_text(x), F.lit(""))), basename(path))


def excluded(path: Column, folders: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for f in folders:
        if f:
            out = out | (path == f) | path.startswith(f + "/")
    return out


def model_file_path(url: Column, model_id: Column) -> Column:
    """Local relative path of a model file's URL; null where it is of another model."""
    mark = F.concat(model_id, F.lit("/"))
    at = F.instr(url, mark)
    rest = F.regexp_replace(F.substring(url, at + F.length(mark), F.length(url)), r"^resolve/[^/]+/", "")
    return F.when(at > 0, F.concat(mark, rest))


def trim_slash(url: Column) -> Column:
    return F.regexp_replace(url, r"/\z", "")
