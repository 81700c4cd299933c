"""Pieces of DuckDB SQL that mean the same as the expressions of this package. DuckDB's
regular expressions have no look-around and ASCII classes only, so classes are spelled out
and word edges are written as the characters next to them."""

from __future__ import annotations

from ..functions.text import ORDER_NUMBERS

SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"\p{L}\p{N}_"
FIRST, LAST = rf"(?:^|[^{W}])", rf"(?:$|[^{W}])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p: str) -> str:
    r"""\s and \d spelled out; \b must not occur."""
    out, inside, i = "", False, 0
    while i < len(p):
        c = p[i]
        if c == "\\" and p[i + 1] in "sd":
            body = SP if p[i + 1] == "s" else r"\p{Nd}"
            out += body if inside or p[i + 1] == "d" else f"[{body}]"
            i += 2
            continue
        if c == "\\":
            out += p[i : i + 2]
            i += 2
            continue
        inside = (c == "[" or inside) and c != "]"
        out += c
        i += 1
    return out


def sub(x: str, p: str, r: str = "''") -> str:
    return f"regexp_replace({x}, {q(p)}, {r}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^[{SP}]+|[{SP}]+$")


def rstrip(x: str) -> str:
    return sub(x, f"[{SP}]+$")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(f'[^{SP}]+')})"


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def lines(x: str, body: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {body}), chr(10))"


def nfc_scrub(x: str) -> str:
    return strip(sub(f"nfc_normalize({x})", r"[^\P{C}\n\r\t]"))


#: The patterns of operators.clean in this dialect.
PROTECTED = [
    r"(?i)G\.O\.|Government Order|G\.O\s*No",
    rf"(?i){FIRST}(?:Section|Clause|Article|Rule|Chapter){LAST}",
    rf"(?i){FIRST}(?:Act|Circular|Notification|Order|Gazette){LAST}",
    rf"{FIRST}\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}{LAST}",
    rf"{FIRST}No\.\s*\d+",
    rf"{FIRST}Rs\.?\s*\d+",
    rf"{FIRST}Proclaimed|Enacted|Whereas|In exercise",
]


def protected(x: str) -> str:
    return "(" + " OR ".join(has(x, re2(p)) for p in PROTECTED) + ")"


def blanked(x: str, pattern: str) -> str:
    return lines(x, f"CASE WHEN {has(strip('l'), pattern)} AND NOT {protected('l')} THEN '' ELSE l END")


def clean_steps(x: str) -> list[tuple[str, str]]:
    """(name, SQL) of the nine steps, each over the column of the one before."""
    return [
        ("c1", f"replace(translate(nfc_normalize({x}), chr(8216)||chr(8217)||chr(8220)||chr(8221)||chr(8211)||chr(160)||chr(8239), '''''\"\"-  '), chr(8212), ' - ')"),
        ("c2", sub("c1", r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")),
        ("c3", blanked("c2", re2(r"(?i)^(?:[\-–—]?\s*Page\s*\d+\s*[\-–—]?|[\-–—]\s*\d+\s*[\-–—]|\d+)$"))),
        ("c4", blanked("c3", r"(?i)^(?:CONFIDENTIAL|DRAFT|RESTRICTED|OFFICIAL USE ONLY|NOT FOR DISTRIBUTION)$")),
        ("c5", sub("c4", r"[-_=*~]{5,}", "chr(10)")),
        ("c6", sub("c5", r"\.{4,}", "'...'")),
        ("c7", blanked("c6", r"^[^\p{L}\p{N}_\n]{1,3}$")),
        ("c8", lines(sub(sub("c7", r"[ \t]+", "' '"), r"\n{3,}", "chr(10)||chr(10)"), rstrip("l"))),
        ("c9", nfc_scrub("c8")),
    ]


def clean(source: str, x: str = "text") -> str:
    """A query over ``source`` with all its columns and c9, the cleaned text."""
    for name, sql in clean_steps(x):
        source = f"(SELECT *, {sql} AS {name} FROM {source})"
    return source


def orders(x: str, use: str = "clean") -> str:
    found = "flatten([" + ", ".join(f"regexp_extract_all({x}, {q(re2('(?i)' + p))})" for p in ORDER_NUMBERS[use]) + "])"
    return f"CASE WHEN {x} IS NOT NULL THEN list_sort(list_distinct(list_transform({found}, lambda g: {strip('g')}))) END"


def mentions(x: str) -> str:
    return f"regexp_extract_all({x}, {q(re2('(?i)' + ORDER_NUMBERS['chunk'][0]))})"


def ascii_words(x: str) -> str:
    """Other marks become blanks and other letters an ASCII one, so that ASCII word edges
    fall where Unicode ones do."""
    return sub(sub(x, rf"[^\x00-\x7F\p{{L}}\p{{N}}{SP}]", "' '"), rf"[^\x00-\x7F{SP}]", "'q'")


#: The patterns of operators.verify.
ENTITIES = [
    r"\b[0-9]+(?:\.[0-9]+)?\b", r"\b[0-9]{1,2}[/\-][0-9]{1,2}[/\-][0-9]{2,4}\b", r"\b(?:19|20)[0-9]{2}\b",
    r"(?i)G\.O\.\s*(?:Ms\.|Rt\.|No\.?)?\s*[0-9]+", r"(?i)GO\s*(?:No\.?)?\s*[0-9]+",
    r"(?i)(?:Section|Clause|Article|Rule|Chapter)\s+[0-9]+(?:\.[0-9]+)*",
    r"(?i)\b[0-9]+\s+(?:years?|months?|days?|weeks?|hours?)\b", r"Rs\.?\s*[0-9][0-9,]*", r"\b[0-9]+(?:\.[0-9]+)?%",
]


def entities(x: str) -> str:
    found = f"regexp_extract_all({x}, {q(re2(ENTITIES[0]))})"
    for p in ENTITIES[1:]:
        found = f"list_concat({found}, regexp_extract_all({x}, {q(re2(p))}))"
    return f"CASE WHEN {x} IS NOT NULL THEN list_sort(list_distinct(list_transform({found}, lambda g: lower({strip('g')})))) END"


def tokens(x: str, stopwords: list[str]) -> str:
    stop = "[" + ", ".join(q(w) for w in stopwords) + "]"
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[{W}]+')), lambda w: length(w) > 1 AND NOT list_contains({stop}, w))"


def sentence_list(x: str, marks: str = ".!?।") -> str:
    return f"string_split({sub(x, f'([{marks}])[{SP}]+', chr(39) + chr(92) + '1' + chr(39) + '||chr(1)')}, chr(1))"


def fold(items: str, step: str, a: str = "a", b: str = "b") -> str:
    """Strings folded from the left into a list: ``step`` takes the state (o: the list so far,
    c: the string held) and an item, of the same form; what is held at the end is appended."""
    start = "{'o': CAST([] AS VARCHAR[]), 'c': ''}"
    z = f"list_reduce(list_prepend({start}, list_transform({items}, lambda s: {{'o': CAST([] AS VARCHAR[]), 'c': s}})), lambda {a}, {b}: {step})"
    return f"list_transform([{z}], lambda z: CASE WHEN z.c <> '' THEN list_append(z.o, z.c) ELSE z.o END)[1]"


def _size(x: str) -> str:
    return f"len({words(x)})"


def translation_pieces(x: str, limit: int) -> str:
    held = strip("(a.c || ' ' || b.c)")
    whole = f"greatest(0, (length(b.c) - 1) // {limit})"
    cuts = f"list_transform(range(0, {whole}), lambda i: substr(b.c, i::INT * {limit} + 1, {limit}))"
    step = f"CASE WHEN length(a.c) + length(b.c) + 1 <= {limit} THEN {{'o': a.o, 'c': {held}}} ELSE {{'o': list_concat(CASE WHEN a.c <> '' THEN list_append(a.o, a.c) ELSE a.o END, {cuts}), 'c': substr(b.c, {whole}::INT * {limit} + 1)}} END"
    string_parts = sub(x, f"([.!?।॥\\n])[{SP}]+", "'\\1'||chr(1)")
    return f"CASE WHEN length({x}) <= {limit} THEN [{x}] ELSE {fold(f'string_split({string_parts}, chr(1))', step)} END"


def blocks(x: str, limit: int) -> str:
    """operators.chunk.blocks: paragraphs packed under a limit of words, then sentences."""

    def pack(items: str, glue: str, a: str, b: str, oversized: str | None = None) -> str:
        whole = f"CASE WHEN {a}.c <> '' THEN {strip(f'({a}.c || {glue} || {b}.c)')} ELSE {b}.c END"
        kept = f"CASE WHEN {a}.c <> '' THEN list_append({a}.o, {a}.c) ELSE {a}.o END"
        alone = f"{{'o': {kept}, 'c': {b}.c}}"
        if oversized:
            alone = f"CASE WHEN {_size(f'{b}.c')} <= {limit} THEN {alone} ELSE {{'o': list_concat({kept}, {oversized}), 'c': ''}} END"
        return fold(items, f"CASE WHEN {_size(whole)} <= {limit} THEN {{'o': {a}.o, 'c': {whole}}} ELSE {alone} END", a, b)

    def some(found: str, otherwise: str) -> str:
        return f"list_transform([{found}], lambda f: CASE WHEN len(f) > 0 THEN f ELSE [{otherwise}] END)[1]"

    by_sentence = some(pack(sentence_list("b.c", ".!?।॥"), "' '", "u", "v"), "b.c")
    packed = pack(f"string_split_regex({x}, '\\n{{2,}}')", "chr(10)||chr(10)", "a", "b", by_sentence)
    return f"CASE WHEN {_size(x)} <= {limit} THEN [{x}] ELSE {some(packed, x)} END"


def chunks(source: str, headings: list[str], label: str, pages: str, most: int, least: int, overlap: int) -> str:
    """CTEs ending in ``done`` (doc_id, chunk_id, label, cs, ce, text, pages): operators.chunk
    over ``source`` (doc_id, text) with the page ranges of ``pages``."""
    marked = sub("text", "(?m)^((?:" + "|".join(headings) + "))", "chr(1)||'\\1'")
    return f"""WITH RECURSIVE s AS (SELECT doc_id, string_split({marked}, chr(1)) AS l FROM {source} WHERE {has("text", f"[^{SP}]")}),
 p AS (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) AS i FROM s),
 o AS (SELECT *, (sum(length(body)) OVER (PARTITION BY doc_id ORDER BY i) - length(body))::INT AS pos, CASE WHEN i > 1 THEN {label} END AS label FROM p),
 e AS (SELECT doc_id, i, pos, label, body, {blocks("body", most)} AS bl FROM o WHERE {has("body", f"[^{SP}]")}),
 u AS (SELECT doc_id, i, pos, label, body, unnest(bl) AS block, generate_subscripts(bl, 1) AS j FROM e),
 b AS (SELECT doc_id, label, j = 1 AS first, {strip("block")} AS own, pos + instr(body, block)::INT - 1 AS cs, length(block)::INT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM u),
 r AS (SELECT doc_id, 0::BIGINT AS k, 0 AS number, '' AS tail, ''::VARCHAR AS text, ''::VARCHAR AS label, 0 AS cs, 0 AS ce FROM (SELECT DISTINCT doc_id FROM b)
  UNION ALL SELECT doc_id, k, CASE WHEN made THEN number + 1 ELSE number END, CASE WHEN made THEN array_to_string(list_transform([{words("new")}], lambda w: w[greatest(1, len(w) - {overlap - 1}):len(w)])[1], ' ') ELSE tail END,
   CASE WHEN made THEN new WHEN new = '' THEN text ELSE text || chr(10)||chr(10) || new END, CASE WHEN made THEN next_label ELSE label END, CASE WHEN made THEN next_cs ELSE cs END, CASE WHEN made THEN next_cs + n ELSE ce END
   FROM (SELECT *, new <> '' AND NOT (first AND number > 0 AND {_size("new")} < {least}) AS made FROM
    (SELECT r.doc_id, b.k, r.number, r.tail, r.text, r.label, r.cs, r.ce, b.label AS next_label, b.cs AS next_cs, b.n, b.first, CASE WHEN r.tail <> '' AND b.first THEN r.tail || chr(10)||chr(10) || b.own ELSE b.own END AS new FROM r JOIN b ON b.doc_id = r.doc_id AND b.k = r.k + 1))),
 c AS (SELECT doc_id, number, arg_max(text, k) AS text, arg_max(nullif(label, ''), k) AS label, arg_max(cs, k) AS cs, arg_max(ce, k) AS ce FROM r WHERE number > 0 GROUP BY doc_id, number),
 g AS (SELECT doc_id, number, number - 1 AS chunk_id, text, label, cs, ce, [{{'lo': cs, 'hi': ce}}] AS spans FROM c WHERE number = 1
  UNION ALL SELECT g.doc_id, c.number, CASE WHEN j THEN g.chunk_id ELSE c.number - 1 END, CASE WHEN j THEN g.text || chr(10)||chr(10) || c.text ELSE c.text END, CASE WHEN j THEN g.label ELSE c.label END, CASE WHEN j THEN g.cs ELSE c.cs END, c.ce, CASE WHEN j THEN list_append(g.spans, {{'lo': c.cs, 'hi': c.ce}}) ELSE [{{'lo': c.cs, 'hi': c.ce}}] END
   FROM (SELECT *, label IS NULL AND {_size("text")} < {least} AS j FROM g) g JOIN c ON c.doc_id = g.doc_id AND c.number = g.number + 1),
 d AS (SELECT doc_id, chunk_id, arg_max(text, number) AS text, arg_max(label, number) AS label, arg_max(cs, number) AS cs, arg_max(ce, number) AS ce, arg_max(spans, number) AS spans FROM g GROUP BY doc_id, chunk_id),
 t AS (SELECT doc_id, chunk_id, unnest(spans) AS sp, generate_subscripts(spans, 1) AS i FROM d),
 f AS (SELECT t.doc_id, t.chunk_id, m.page, min(t.i) AS i FROM t JOIN ({pages}) m ON m.doc_id = t.doc_id AND t.sp.lo < m.hi AND t.sp.hi > m.lo GROUP BY ALL),
 h AS (SELECT doc_id, chunk_id, string_agg(page::VARCHAR, ',' ORDER BY i, page) AS pages FROM f GROUP BY ALL),
 done AS (SELECT d.*, coalesce(h.pages, '') AS pages FROM d LEFT JOIN h ON h.doc_id = d.doc_id AND h.chunk_id = d.chunk_id)"""
