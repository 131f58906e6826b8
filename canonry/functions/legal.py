"""Scalar functions on legal texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canonry.functions import vocabulary as V
from canonry.functions.text import squeeze


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def slugify(col: Column | str) -> Column:
    """ASCII letters and digits of the lower-case text joined by hyphens; `unknown` if none remain or null."""
    slug = F.regexp_replace(F.lower(_col(col)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def document_type(col: Column | str) -> Column:
    """Canonical type by the first known word in the text; `other` without one."""
    text, out = F.lower(_col(col)), F.lit("other")
    for word, kind in reversed(V.DOCUMENT_TYPES):
        out = F.when(text.contains(word), kind).otherwise(out)
    return out


def extract_year(col: Column | str) -> Column:
    """A year 19xx or 20xx that stands alone, else the first four digits if between 1900 and 2100, else null."""
    text = _col(col)
    alone = F.nullif(F.regexp_extract(text, r"(?U)\b((?:19|20)\d{2})\b", 1), F.lit(""))
    digits = F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit(""))
    return F.coalesce(alone, F.when(digits.cast("int").between(1900, 2100), digits))


def document_status(col: Column | str) -> Column:
    """One of four states; unknown texts and null are taken to be in force."""
    text = F.lower(F.trim(_col(col)))
    has = lambda *words: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    return (
        F.when(text.isNull() | text.isin("", "nan", "none", "n/a"), V.IN_FORCE)
        .when(has("hết hiệu lực", "het hieu luc"), F.when(has("một phần", "mot phan", "1 phần"), V.PARTLY_EXPIRED).otherwise(V.EXPIRED))
        .when(has("chưa", "chua", "sắp"), V.NOT_YET)
        .otherwise(V.IN_FORCE)
    )


def status_on(effective: Column, as_of: Column) -> Column:
    """Not yet in force if the ISO day `effective` is later than the day `as_of`."""
    return F.when((F.length(effective) == 10) & (effective > as_of), V.NOT_YET).otherwise(V.IN_FORCE)


def document_number(col: Column | str) -> Column:
    """The first document number in a text, the form with a year first; null without one."""
    text = _col(col)
    long = F.nullif(F.regexp_extract(text, V.NUMBER_WITH_YEAR, 1), F.lit(""))
    return F.coalesce(long, F.nullif(F.regexp_extract(text, V.NUMBER_SHORT, 1), F.lit("")))


def signer(col: Column | str) -> Column:
    """Name and number of `name:number` as a struct; the number is null if there is none or it is no number."""
    text = _col(col)
    none = text.isNull() | F.lower(F.trim(text)).isin("nan", "", "none")
    name = F.when(text.contains(":"), F.trim(F.split(text, ":")[0])).otherwise(text)
    number = F.when(text.contains(":"), F.trim(F.get(F.split(text, ":"), F.lit(1))).try_cast("long"))
    return F.struct(F.when(~none, name).alias("name"), F.when(~none, number).alias("id"))


def document_key(col: Column | str) -> Column:
    """Upper case without blanks, dots, hyphens and slashes."""
    return F.upper(F.regexp_replace(_col(col), r"[\s.\-/]", ""))


def parent_law_id(kind: Column, number: Column, year: Column, title: Column) -> Column:
    """Identifier of a cited document from its type, number or title, and year."""
    basis = F.coalesce(F.nullif(number, F.lit("")), F.nullif(title, F.lit("")), F.lit("unknown"))
    return F.concat_ws("::", F.lit("parent"), kind, slugify(basis), F.coalesce(F.nullif(year, F.lit("")), F.lit("unknown")))


_REFERENCE = V.BASIS_REFERENCE


def basis_references(line: Column | str) -> Column:
    """The documents that a line of legal bases names, as an array of structs."""
    text = squeeze(line)
    whole = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))

    def describe(ref: Column) -> Column:
        kind, number, year = document_type(F.regexp_extract(ref, _REFERENCE, 1)), document_number(ref), extract_year(ref)
        title = F.trim(ref)
        return F.struct(
            text.alias("basis_line"), kind.alias("doc_type"), F.coalesce(number, F.lit("")).alias("doc_number"), F.coalesce(year, F.lit("")).alias("doc_year"), title.alias("doc_title"),
            parent_law_id(kind, F.coalesce(number, F.lit("")), F.coalesce(year, F.lit("")), title).alias("parent_law_id"),
        )

    return F.transform(whole, describe)


def hierarchy_rank(kind: Column | str) -> Column:
    """Rank of a document type, 1 highest; 99 for others and null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in V.TYPE_RANKS.items() for x in pair]), F.trim(_col(kind))), F.lit(99))


def uuid5(name: Column | str, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """UUID version 5 of a text in a namespace (default: DNS), computed by SHA-1 without leaving the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(_col(name), "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab" * 4]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def has_word(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands alone in the text, whatever its case; blanks in a word match any blanks."""
    return text.rlike(r"(?iuU)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b")


def entity_hint(text: Column | str) -> Column:
    """Whether a text may name entities."""
    return F.coalesce(has_word(_col(text), V.ENTITY_HINTS), F.lit(False))


def relation_hint(text: Column | str) -> Column:
    """Whether a text has both a verb of relation and a document number."""
    return F.coalesce(has_word(_col(text), V.RELATION_HINTS) & _col(text).rlike(V.NUMBER_HINT), F.lit(False))


def letter_count(text: Column | str) -> Column:
    """Number of letters in a text; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(_col(text), r"\P{L}+", "")), F.lit(0))


def line_kind(line: Column | str) -> Column:
    """The structural kind of a trimmed line, first match wins."""
    text = F.trim(_col(line))
    return (
        F.when(text == "", "blank")
        .when(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 2, "table")
        .when(text.rlike(r"(?iu)^(chương|phần)\s+(thứ\s+)?[a-z0-9]+"), "chapter")
        .when(text.rlike(r"(?iu)^(điều|mục)\s+[0-9]+"), "article")
        .when(text.rlike(r"(?iu)^(phụ\s+lục|danh\s+mục|mẫu\s+số)"), "appendix")
        .when(text.rlike(r"(?iu)^(căn\s+cứ)"), "basis")
        .when(text.rlike(r"^[0-9]+(\.[0-9]+)*[.)]|^\([0-9]+\)|(?iu)^khoản\s+[0-9]+"), "clause")
        .when(text.rlike(r"^[a-zđ]\s*[).]"), "point")
        .otherwise("text")
    )


def _first_intent(question: Column | str, give) -> Column:
    text, out = F.lower(_col(question)), F.lit(None)
    for name, words, labels, relations in reversed(V.INTENTS):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = F.when(hit, give(name, labels, relations)).otherwise(out)
    return out


def intent(question: Column | str) -> Column:
    """The first intent one of whose keywords the question has; null without one."""
    return _first_intent(question, lambda name, labels, relations: F.lit(name))


def intent_scope(question: Column | str) -> Column:
    """The labels and relations that the question's intent seeks an answer among, as a struct of arrays; null without an intent."""
    return _first_intent(question, lambda name, labels, relations: F.struct(F.array(*map(F.lit, labels)).alias("labels"), F.array(*map(F.lit, relations)).alias("relations")))


def relation_name(raw: Column | str, cross: dict[str, str] = V.CROSS_NAMES, aliases: dict[str, str] = V.RELATION_ALIASES, fixed: list[str] | None = None) -> Column:
    """Canonical relation name: cross names, blacklist, aliases, fixed names, verb root of at least four letters, else itself; `RELATED_TO` for null and empty."""
    text = F.replace(F.upper(F.trim(_col(raw))), F.lit(" "), F.lit("_"))
    lookup = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    crossed = F.coalesce(lookup(cross, text), text)
    named = F.coalesce(lookup(aliases, crossed), crossed)
    known = V.NODE_RELATIONS if fixed is None else fixed
    first, root = F.split(named, "_")[0], F.lit(None).cast("string")
    for prefix in sorted((p for p in V.VERB_ROOTS if len(p) > 3), key=len):
        root = F.when(first.startswith(prefix), V.VERB_ROOTS[prefix]).otherwise(root)
    return F.when(text.isNull() | (text == ""), "RELATED_TO").when(crossed.isin(V.BLACKLIST), "RELATED_TO").when(named.isin(known), named).otherwise(F.coalesce(root, named))


def document_relation_name(raw: Column | str) -> Column:
    """Canonical name of a relation between documents; names that aren't upper snake case become `BASED_ON`."""
    text = F.replace(F.upper(F.trim(_col(raw))), F.lit(" "), F.lit("_"))
    named = F.when(text == "REFERENCES", "BASED_ON").when(text == "APPLIES", "APPLIES_TO").otherwise(text)
    return F.when(named.isin(V.DOC_RELATIONS) | named.rlike(r"^[A-Z][A-Z0-9_]*$"), named).otherwise("BASED_ON")


def entity_type(raw: Column | str) -> Column:
    """Canonical entity label: alias, known label in any case, a known label's first four letters, a PascalCase label, else `Concept`."""
    text = F.trim(_col(raw))
    text = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in V.ENTITY_TYPE_ALIASES.items() for x in pair]), text), text)
    lower, out = F.lower(text), F.when(text.rlike("^[A-Z][A-Za-z0-9]+$"), text).otherwise("Concept")
    for label in reversed(V.ENTITY_TYPES):
        out = F.when((lower != "") & F.lit(label.lower()).startswith(F.substring(lower, 1, 4)), label).otherwise(out)
    for label in reversed(V.ENTITY_TYPES):
        out = F.when(lower == label.lower(), label).otherwise(out)
    return F.when(text.isNull() | (text == ""), "Concept").otherwise(out)


def entity_name(raw: Column | str) -> Column:
    """An entity's name with single blanks and a capital first letter; null for words that only refer to one."""
    text = squeeze(raw)
    lower = F.lower(text)
    vague = lower.isin(V.COREFERENCE)
    for end in V.COREFERENCE_ENDS:
        vague = vague | lower.endswith(end)
    return F.when((text != "") & ~vague, F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2))))


def json_values(raw: Column | str, path: str) -> Column:
    """A value of a JSON text after trailing commas are removed; null if it isn't JSON."""
    return F.get_json_object(F.regexp_replace(_col(raw), r",\s*([\]}])", "$1"), path)


def order_key(chunk_id: Column | str) -> Column:
    """Sort key of a chunk id: the number after `c`, the number after `p`, the id; missing numbers count as 0."""
    text = _col(chunk_id)
    number = lambda mark: F.coalesce(F.regexp_extract(text, rf"{mark}(\d+)", 1).try_cast("int"), F.lit(0))
    return F.struct(number("c").alias("c"), number("p").alias("p"), text.alias("id"))


#: Fixed value: how articles and clauses are cited in running text.
CITATION = r"(?iu)(?:điều|khoản|điểm|mục|chương)\s+(?:\d+[a-zđ]?|[a-zđ]|[ivxlc]+)(?U)\b"


def citations_in(text: Column | str) -> Column:
    """Distinct citations of articles, clauses and document numbers in a text, folded to lower case with single blanks, in order."""
    found = F.concat(F.regexp_extract_all(_col(text), F.lit(CITATION), F.lit(0)), F.regexp_extract_all(_col(text), F.lit(r"\d+/\d{4}/[A-ZĐ][A-Z0-9Đ\-]*"), F.lit(0)))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))))


def question_entities(question: Column | str, most: int = 5) -> Column:
    """The first few distinct document numbers and ministries that a question names."""
    text = _col(question)
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\d+/\d{4}/[A-ZĐ][A-Z0-9Đ\-]*"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"Bộ\s+\p{Lu}\p{L}*(?:\s+\p{Lu}\p{L}*)*"), F.lit(0)))
    return F.slice(F.array_distinct(found), 1, most)


def article_body(text: Column, article: Column) -> Column:
    """The text from a heading `article` to the next article or chapter heading; null if it isn't there."""
    start = F.regexp_instr(F.concat(F.lit("\n"), text), F.concat(F.lit(r"(?iu)\n\s*"), F.regexp_replace(article, r"([.()\[\]\\+*?^$|{}])", r"\\$1"), F.lit(r"(?![0-9])")))
    rest = F.when(start > 0, F.regexp_replace(F.substr(text, F.greatest(start, F.lit(1))), r"^\s+", ""))
    end = F.regexp_instr(rest, F.lit(r"(?iu)\n\s*(điều|chương|mục|phần)\s+[0-9ivxlc]+"))
    return F.rtrim(F.when(end > 0, F.substr(rest, F.lit(1), end - 1)).otherwise(rest))


def is_legal_document(name: Column | str) -> Column:
    """Whether a cited name is that of a document: it has a number or a legal keyword, or isn't just an organisation."""
    text = F.lower(F.trim(_col(name)))
    keyword = text.rlike(V.LEGAL_KEYWORDS)
    organisation = text.rlike(V.ORGANISATION_START)
    return F.coalesce((F.length(text) >= 4) & (text.rlike(r"\d+[/-][a-zđ]+") | keyword | ~organisation), F.lit(False))


def without_self_references(text: Column | str) -> Column:
    """A text without `this law` and the like."""
    return F.regexp_replace(_col(text), V.SELF_REFERENCE, "")


def verb_stem(relation: Column | str) -> Column:
    """A relation name without its closing preposition."""
    return F.regexp_replace(_col(relation), "_(BY|TO|IN|FOR|FROM|WITH|AS|VIA|ON|AT|OF)$", "")


def file_name(text: Column | str) -> Column:
    """A text fit for a file name: forbidden characters become `_`."""
    return F.substring(F.regexp_replace(F.trim(_col(text)), r'[\\/:*?"<>|\s]+', "_"), 1, 150)


def embedding_input(text: Column | str) -> Column:
    """Text for an embedding model: no NUL, `N/A` for nothing."""
    clean = F.replace(_col(text), F.lit("\u0000"), F.lit(""))
    return F.when(F.trim(clean) != "", clean).otherwise("N/A")


def year_of_date(text: Column | str) -> Column:
    """The year of D/M/Y or Y-M-D; null for other forms."""
    raw = F.trim(_col(text))
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"^\d{1,2}/\d{1,2}/(\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"^(\d{4})-\d{1,2}-\d{1,2}", 1), F.lit("")))


def is_greeting(text: Column | str) -> Column:
    """Whether a message is nothing but a greeting or thanks."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(_col(text))), r"[!.?,\s]+$", "").isin(V.GREETINGS), F.lit(False))


def after_marker(text: Column | str, marker: str = "Nội dung:\n") -> Column:
    """What follows the first marker in a text; the whole text without one."""
    raw = _col(text)
    at = F.instr(raw, F.lit(marker))
    return F.when(at > 0, F.substr(raw, at + len(marker))).otherwise(raw)


def translated(name: Column | str, names: dict[str, str]) -> Column:
    """A display name by lookup, else the name itself."""
    raw = _col(name)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), raw), raw) if names else raw


def rerank_text(citation: Column, title: Column, content: Column) -> Column:
    """One text of a hit for a reranking model; missing parts are left out."""
    return F.concat_ws("\n", *[F.nullif(F.trim(c), F.lit("")) for c in (citation, title, content)])


def display_id(*candidates: Column) -> Column:
    """The first candidate that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates])


def label_name(raw: Column | str) -> Column:
    """A label of letters, digits and underscores that begins with a letter; known synonyms become one label, nothing becomes `Entity`."""
    kept = F.regexp_replace(F.trim(_col(raw)), "[^a-zA-Z0-9_]", "")
    started = F.when(kept.rlike("^[^a-zA-Z]"), F.concat(F.lit("E_"), kept)).otherwise(kept)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in V.ENTITY_TYPE_ALIASES.items() for x in pair]), started)
    return F.coalesce(known, F.nullif(started, F.lit("")), F.lit("Entity"))


def edge_type(raw: Column | str) -> Column:
    """A relation in upper snake case with a few synonyms resolved; nothing becomes `RELATED_TO`."""
    kept = F.regexp_replace(F.upper(F.trim(_col(raw))), "[^A-Z0-9_]+", "_")
    name = F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in V.EDGE_ALIASES.items() for x in pair]), name)
    return F.coalesce(known, F.nullif(name, F.lit("")), F.lit("RELATED_TO"))


def triplet(source: Column, source_type: Column, relation: Column, target: Column, target_type: Column) -> Column:
    """A legacy triplet as a struct of two names, two labels and a relation, or null without both names."""
    bare = lambda c, other: F.coalesce(F.nullif(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit(other))
    named = F.coalesce(F.nullif(F.regexp_replace(F.upper(F.replace(relation, F.lit(" "), F.lit("_"))), r"[^\p{L}\p{N}_]", ""), F.lit("")), F.lit("RELATED_TO"))
    whole = F.struct(F.trim(source).alias("source"), bare(source_type, "Entity").alias("source_type"), named.alias("relation"), F.trim(target).alias("target"), bare(target_type, "Entity").alias("target_type"))
    return F.when((source != "") & (target != ""), whole)


def sector_hints(question: Column | str, sectors: list[str], most: int = 3) -> Column:
    """The first `most` of the given sectors that the question names."""
    lower = F.lower(_col(question))
    return F.slice(F.filter(F.array(*[F.lit(s) for s in sectors]) if sectors else F.array().cast("array<string>"), lambda s: F.contains(lower, F.lower(s))), 1, most)


def file_hints(text: Column | str) -> Column:
    """What an uploaded text adds to a question: its first document number, and up to three headings in the order of their letters."""
    number = F.nullif(F.regexp_extract(_col(text), r"\d+/\d{4}/[A-Za-zĐđ\-]+", 0), F.lit(""))
    headings = F.regexp_extract_all(_col(text), F.lit(r"(?:Điều|Khoản|Mục|Chương|Phụ lục)\s+\d+[a-z]?"), F.lit(0))
    return F.struct(number.alias("number"), F.slice(F.array_sort(F.array_distinct(headings)), 1, 3).alias("headings"))
