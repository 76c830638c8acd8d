"""Tokenizers and small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a query drops.
STOPWORDS = (
    "the a an is are be how where what when which does do i of to into for from on in it its and "
    "or s as we use used using module responsible there here that this with by at"
).split()
MIN_TERM = 3

# Extensions and what they stand for.
FORMATS = {"ts": "ts", "tsx": "ts", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "py": "py", "md": "md"}
INCLUDED = (".ts", ".js", ".mjs", ".cjs", ".py", ".md")
CONVERTED = {"pdf": "pdf", "docx": "docx"}
PLAIN = {"txt": "txt", "text": "txt", "log": "log", "csv": "csv"}
MARKDOWN = {"md": "md", "markdown": "md"}

# Latin letters with marks and the letters under them.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def _words(col: Column) -> Column:
    return F.filter(F.split(col, " ", -1), lambda x: x != "")


def split_ident(col: Column) -> Column:
    """Parts of identifiers: a space between aB, every other run of non-alphanumeric ASCII a space, lower case."""
    humps = F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1 $2")
    return _words(F.lower(F.regexp_replace(humps, "[^A-Za-z0-9]+", " ")))


def ident_words(col: Column) -> Column:
    """The parts of split_ident() as one string, each between two spaces of its own: ' a  b '; two spaces if there are none.

    Counting a term in it takes built-in string functions only, which the engine compiles; the array form
    is interpreted element by element.
    """
    humps = F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1 $2")
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(humps, "[^A-Za-z0-9]+", "  "))), F.lit(" "))


def word_count(words: Column) -> Column:
    """The number of words of ident_words(): two spaces each, none in '  '."""
    spaces = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))
    return (spaces / 2).cast("int") - (words == "  ").cast("int")


def term_count(words: Column, term: str) -> Column:
    return ((F.octet_length(words) - F.octet_length(F.replace(words, F.lit(f" {term} "), F.lit("")))) / (len(term.encode()) + 2)).cast("int")


def camel_parts(body: Column) -> Column:
    """Parts of the camel-case identifiers in a body, with repeats."""
    names = F.regexp_extract_all(body, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))
    camel = F.filter(names, lambda x: x.rlike("^[a-z_$]") & x.rlike("[a-z][A-Z]"))
    return F.flatten(F.transform(camel, split_ident))


def unicode_tokens(col: Column) -> Column:
    """Lower-case words of any script without marks on Latin letters."""
    return _words(F.regexp_replace(F.translate(F.lower(col), _MARKED, _PLAIN), r"[^\p{L}\p{N}]+", " "))


def index_tokens(path: Column, symbols: Column, body: Column) -> Column:
    """What a document is found by: its path twice, its symbols, its body and the parts of camel-case names."""
    p = split_ident(path)
    return F.concat(p, p, F.flatten(F.transform(F.coalesce(symbols, F.array().cast("array<string>")), split_ident)), unicode_tokens(F.coalesce(body, F.lit(""))), camel_parts(F.coalesce(body, F.lit(""))))


def keywords(col: Column) -> Column:
    """Distinct terms of a query in order: identifier parts of three letters or more that aren't stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(split_ident(col), lambda x: (F.length(x) >= MIN_TERM) & ~F.array_contains(stop, x)))


def query_terms(text: str) -> list[str]:
    """keywords() of one query, on the driver."""
    import re

    parts = re.sub("[^A-Za-z0-9]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", text)).lower().split()
    return list(dict.fromkeys(w for w in parts if len(w) >= MIN_TERM and w not in STOPWORDS))


def match_expression(text: str) -> str | None:
    """The query as an OR of quoted terms, None without any."""
    terms = query_terms(text)
    return " OR ".join(f'"{t}"' for t in terms) or None


# --- kinds and formats


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def classify_path(path: Column) -> Column:
    """struct(kind, format) by extension."""
    fmt = _lookup(extension(path), FORMATS)
    return F.struct(F.when(fmt == "md", "doc").otherwise("code").alias("kind"), fmt.alias("format"))


def classify_upload(name: Column) -> Column:
    """struct(route, format) of an uploaded file: convert, markdown, text or blob."""
    ext = extension(name)
    known = F.coalesce(_lookup(ext, CONVERTED), _lookup(ext, MARKDOWN), _lookup(ext, PLAIN))
    route = (
        F.when(_lookup(ext, CONVERTED).isNotNull(), "convert").when(_lookup(ext, MARKDOWN).isNotNull(), "markdown")
        .when(_lookup(ext, PLAIN).isNotNull(), "text").otherwise("blob")
    )
    return F.struct(route.alias("route"), F.coalesce(known, F.when(ext.rlike("^[a-z0-9]{1,16}$"), ext).otherwise("bin")).alias("format"))


def derive_doc_id(name: Column) -> Column:
    """doc:<slug> of a file name without its extension."""
    stem = F.regexp_replace(name, r"\.[^./\\]+$", "")
    slug = F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("doc:"), F.lower(slug))


# --- numbers


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors; 0 if one is missing or their lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), F.coalesce(dot, F.lit(0.0))).otherwise(F.lit(0.0))


def minmax(x: Column, low: Column, high: Column, flat: float = 1.0) -> Column:
    """x on the scale from low to high; `flat` where all are equal."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(F.when(x.isNotNull(), F.lit(flat)))


def tokens_of(approx: Column, content: Column) -> Column:
    """A unit's tokens: its own estimate if that is finite and not negative, else a quarter of its characters."""
    told = approx.cast("double")
    ok = told.isNotNull() & ~F.isnan(told) & (told >= 0) & (told < float("inf"))
    return F.when(ok, told).otherwise(F.ceil(F.char_length(F.coalesce(content, F.lit(""))) / 4.0).cast("double"))


HEAD, TAIL = 160, 80


def peek(text: Column) -> Column:
    """struct(head, tail, chars, bytes, truncated) of a parked text."""
    n = F.char_length(text)
    tail = F.when(n > HEAD + TAIL, F.right(text, F.lit(TAIL)))
    return F.struct(F.substring(text, 1, HEAD).alias("head"), tail.alias("tail"), n.alias("chars"), F.octet_length(text).alias("bytes"), (n > HEAD).alias("truncated"))


def risk(n: Column) -> Column:
    return F.when(n <= 2, "low").when(n <= 10, "medium").otherwise("high")


def relative_age(ms: Column) -> Column:
    """Age in whole minutes, hours or days."""
    minutes = F.floor(ms / 60_000)
    return F.when(minutes < 60, F.concat(minutes, F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440), F.lit("d")))


def base_activation(ages: Column) -> Column:
    """ln of the sum of age^-0.5 over accesses, ages below 1 counted as 1."""
    return F.ln(F.aggregate(ages, F.lit(0.0), lambda s, x: s + F.pow(F.greatest(x.cast("double"), F.lit(1.0)), F.lit(-0.5))))


def activation_decay(commits: Column, days: Column) -> Column:
    return (0.4 + 0.1 * F.log10(commits + 1)) * F.log10(F.greatest(days, F.lit(1)))


def context_boost(query: Column, context: Column) -> Column:
    """Half the share of query terms found in the context."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, context)) / F.size(query) * 0.5).otherwise(0.0)
