"""String, URL and JSON functions as Column expressions."""

from __future__ import annotations

import html
import io
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.vector import as_col

#: Hosts that fonts may come from for free, and those that sell them.
FREE_HOSTS = ("www.dafont.com", "fonts.google.com", "www.fontsquirrel.com")
PAID_HOSTS = ("www.myfonts.com",)
FONT_HOSTS = FREE_HOSTS + PAID_HOSTS


def family_of_stem(stem: Column | str) -> Column:
    """Stems end in a space, a letter and its case: the rest."""
    s = as_col(stem)
    return F.left(s, F.length(s) - 3)


def letter_of_stem(stem: Column | str) -> Column:
    s = as_col(stem)
    return F.left(F.right(s, F.lit(2)), F.lit(1))


def market_font(stem: Column | str) -> Column:
    """Marketplace stems: the font is what precedes the first underscore."""
    return F.split_part(as_col(stem), F.lit("_"), F.lit(1))


def market_letter(stem: Column | str) -> Column:
    return F.lower(F.right(as_col(stem), F.lit(1)))


def market_case(stem: Column | str) -> Column:
    """Upper exactly if the last two characters are the same."""
    s = as_col(stem)
    return F.when((F.length(s) > 1) & (F.right(s, F.lit(1)) == F.left(F.right(s, F.lit(2)), F.lit(1))), "u").otherwise("l")


def query_template(q: Column | str) -> Column:
    return F.concat(F.lit("a "), as_col(q), F.lit(" font"))


def last_path_part(tags: Column | str) -> Column:
    return F.element_at(F.split(as_col(tags), "/"), -1)


def url_allowed(url: Column | str, hosts: tuple[str, ...] = FONT_HOSTS) -> Column:
    """https, and neither host nor authority (with user and port) other than a listed host."""
    part = lambda p: F.try_parse_url(as_col(url), F.lit(p))
    return F.coalesce((part("PROTOCOL") == "https") & part("HOST").isin(*hosts) & part("AUTHORITY").isin(*hosts), F.lit(False))


def url_paid(url: Column | str, hosts: tuple[str, ...] = PAID_HOSTS) -> Column:
    return F.coalesce(F.try_parse_url(as_col(url), F.lit("AUTHORITY")).isin(*hosts), F.lit(False))


def font_file(name: Column | str) -> Column:
    return as_col(name).rlike(r"\.(otf|ttf)$")


def parsed_list(text: Column | str) -> Column:
    """A list of strings from model output: an optional code fence (with its json tag) is taken off; anything else is null."""
    t = F.trim(as_col(text))
    inner = F.when(t.startswith("```"), F.regexp_extract(t, r"(?s)^```(?:json)?\s*(.*?)\s*(?:```)?$", 1)).otherwise(t)
    strings = F.from_json(inner, "array<string>")
    quoted = F.regexp_count(inner, F.lit(r'(?s)"(?:[^"\\]|\\.)*"'))
    return F.when(inner.startswith("[") & strings.isNotNull() & ~F.exists(strings, lambda x: x.isNull()) & (quoted == F.size(strings)), strings)


def json_path(text: Column | str, path: str) -> Column:
    return F.get_json_object(as_col(text), f"$.{path}")


#: What isn't text: comments, scripts and styles with what they hold, tags with quoted values, declarations. What isn't closed is text.
_MARKUP = re.compile(
    r"""<!--.*?-->|<(script|style)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>.*?</\1\s*>|</?[a-z][^\s/>]*(?:[^>"']|"[^"]*"|'[^']*')*>|<[!?][^>]*>""",
    re.IGNORECASE | re.DOTALL,
)


#: A character reference with its semicolon.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def page_text(page: str | None, whole: bool = False) -> str | None:
    """The text of one page: markup becomes a space, character references their characters, white space is folded.

    HTML knows some names without their semicolon too; with `whole`, what lacks it stays as it stands.
    """
    if page is None:
        return None
    bare, end = io.StringIO(), 0  # a substitution keeps a list of all pieces
    for m in _MARKUP.finditer(page):
        bare.write(page[end : m.start()])
        bare.write(" ")
        end = m.end()
    bare.write(page[end:])
    text = bare.getvalue()
    del bare
    named = lambda m: html.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0]
    text = _REFERENCE.sub(named, text) if whole else html.unescape(text)
    return _folded(text.replace("\xa0", " ")).strip(" ")


def _folded(text: str, step: int = 1 << 20) -> str:
    """Runs of white space as one space each, a stretch after another."""
    parts: list[str] = []
    for k in range(0, len(text), step):
        part = re.sub("[ \t\n\r\f\v]+", " ", text[k : k + step])
        part = part.removeprefix(" ") if parts and parts[-1].endswith(" ") else part
        if part:
            parts.append(part)
    return "".join(parts)


def html_text(page: Column | str, whole: bool = False) -> Column:
    """Text of a page, in Arrow batches; see page_text. All named and numeric references of HTML 5 are known."""
    return F.pandas_udf(lambda pages: pages.map(lambda p: page_text(p, whole)), T.StringType())(as_col(page))


def prompt(adjectives: Column, tags: Column, plain: Column) -> Column:
    """Labelled sections, one a line; empty ones are left out. Tags of a weight over 0.3 are strong."""
    names = lambda strong: F.array_sort(F.map_keys(F.map_filter(tags, lambda k, w: (w > 0.3) if strong else (w <= 0.3))))
    part = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", ")))
    return F.concat_ws("\n", part("Adjectives", adjectives), part("Strong style tags", names(True)), part("Possible style tags", names(False)), F.when(F.length(plain) > 0, F.concat(F.lit("Description: "), plain)))
