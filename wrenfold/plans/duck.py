"""DuckDB twins of the column builders: each takes and gives SQL text."""

from __future__ import annotations

from ..functions.hashing import pads
from ..functions.vocab import DISPOSABLE, EMAIL_PATTERN, ENTROPY_HIGH, ENTROPY_LENGTH, ENTROPY_LETTERS, KEYBOARD_ROWS, LIMITS, NO_SECTOR, PHRASES, RISKY_TLDS, ROLES, SALUTATIONS, SECTORS, SPAM_TRAPS, TYPOS
from ..operators.contacts import CONTACTS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def with_contacts(sql: str) -> str:
    return f"WITH contacts AS ({CONTACTS}) {sql}"


def text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def too_long(x: str, kind: str) -> str:
    return f"CASE WHEN length({x}) > {LIMITS[kind]} THEN '{kind} field exceeds max length {LIMITS[kind]} (got ' || CAST(length({x}) AS VARCHAR) || ')' END"


def hidden(x: str) -> str:
    return rf"regexp_replace({x}, '[\p{{Cc}}\p{{Cf}}\p{{Co}}]', '', 'g')"


def escaped(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


def markup_free(x: str) -> str:
    """For texts whose < begins a tag and whose & begins no entity."""
    return escaped(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def sanitized(x: str) -> str:
    return f"trim({markup_free(hidden(text(x)))})"


def titled(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda s: upper(s[1]) || lower(s[2:])), '')"


def address(x: str) -> str:
    return titled(f"trim(regexp_replace({sanitized(x)}, '[<>;{{}}\\\\`]', '', 'g'))")


def company(x: str) -> str:
    return titled(f"trim(regexp_replace({sanitized(x)}, '[^A-Za-z0-9 ''.&,()/-]', '', 'g'))")


def phone(x: str) -> str:
    kept = f"trim(regexp_replace({sanitized(x)}, '[^0-9+() .-]', '', 'g'))"
    return f"CASE WHEN NOT starts_with({kept}, '+') AND length(regexp_replace({kept}, '[^0-9]', '', 'g')) >= 10 THEN '+' || {kept} ELSE {kept} END"


def name_parts(x: str) -> str:
    """The name's parts as a list."""
    kept = f"trim(regexp_replace(regexp_replace({sanitized(x)}, '[^A-Za-z ''.-]', '', 'g'), ' +', ' ', 'g'))"
    return f"list_filter(string_split({kept}, ' '), lambda s: s <> '')"


def name_head(parts: str) -> str:
    return f"rtrim(lower(coalesce({parts}[1], '')), '.')"


def capital(x: str) -> str:
    return f"upper({x}[1]) || lower({x}[2:])"


def first_name(parts: str) -> str:
    return f"coalesce({capital(f'(CASE WHEN {name_head(parts)} IN {listed(SALUTATIONS)} THEN {parts}[2] ELSE {parts}[1] END)')}, '')"


def last_name(parts: str) -> str:
    rest = f"(CASE WHEN {name_head(parts)} IN {listed(SALUTATIONS)} THEN {parts}[3:] ELSE {parts}[2:] END)"
    return f"coalesce(array_to_string(list_transform({rest}, lambda s: {capital('s')}), ' '), '')"


def one_at(x: str) -> str:
    return f"length({x}) - length(replace({x}, '@', '')) = 1"


def email_value(x: str) -> str:
    return f"replace(lower({sanitized(x)}), ' ', '')"


def fixed_domain(d: str) -> str:
    return f"CASE {d} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in TYPOS.items()) + f" ELSE {d} END"


def email_full(x: str) -> str:
    v = email_value(x)
    return f"split_part({v}, '@', 1) || '@' || {fixed_domain(f'split_part({v}, {q(chr(64))}, 2)')}"


def email_valid(x: str) -> str:
    return f"({one_at(email_value(x))} AND regexp_matches({email_full(x)}, {q(EMAIL_PATTERN)}))"


def normalized_email(x: str) -> str:
    """For domains that are providers, known misspellings, or far from either."""
    return f"CASE WHEN {email_valid(x)} THEN {email_full(x)} END"


def syntax_ok(x: str) -> str:
    return f"coalesce({x} <> '' AND length({x}) <= {LIMITS['email']} AND {one_at(x)} AND regexp_matches({x}, {q(EMAIL_PATTERN)}), false)"


def domain_of(x: str) -> str:
    return f"CASE WHEN {syntax_ok(x)} THEN split_part(lower({x}), '@', 2) END"


def local_of(x: str) -> str:
    return f"CASE WHEN {syntax_ok(x)} THEN split_part(lower({x}), '@', 1) END"


def disposable(d: str) -> str:
    return f"coalesce({d} IN {listed(DISPOSABLE)}, false)"


def role(d: str) -> str:
    return f"coalesce({d} IN {listed(ROLES)}, false)"


def raw_digits(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9+]', '', 'g')"
    return f"CASE WHEN length({x}) <= 40 THEN (CASE WHEN starts_with({kept}, '+') THEN '+' ELSE '' END) || replace({kept}, '+', '') ELSE '' END"


def repeating(d: str) -> str:
    return f"coalesce(length({d}) > 0 AND length(replace({d}, {d}[1], '')) = 0, false)"


def sequential(d: str) -> str:
    up = "0123456789" * 3
    turn = f"({d}[1] <> {d}[2] AND repeat({d}[1:2], 20)[1:length({d})] = {d})"
    return f"coalesce(length({d}) >= 4 AND (contains({q(up)}, {d}) OR contains({q(up[::-1])}, {d}) OR {turn}), false)"


def dummy(d: str) -> str:
    return f"CASE WHEN {repeating(d)} THEN 'REPEATING_DIGITS' WHEN {sequential(d)} THEN 'DUMMY_SEQUENCE' END"


def phone_tag(x: str) -> str:
    """The ladder without the numbering-plan library."""
    n = f"length(replace({raw_digits(x)}, '+', ''))"
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN 'EMPTY_INPUT' WHEN length({x}) > 40 THEN 'OVERSIZED_INPUT' WHEN {n} < 4 OR {n} > 15 THEN 'INVALID_PHONE_LENGTH' ELSE 'DEPENDENCY_MISSING' END"


def classify_text(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, '')[1:300])), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN [] ELSE string_split({x}, ' ')[1:60] END)"


def tld(d: str) -> str:
    return f"CASE WHEN contains({d}, '.') THEN lower(string_split({d}, '.')[-1]) END"


def trap(d: str) -> str:
    return f"coalesce(trim(lower({d})) IN {listed(SPAM_TRAPS)}, false)"


def risky(d: str) -> str:
    return f"coalesce({tld(f'trim(lower({d}))')} IN {listed(RISKY_TLDS)}, false)"


def letters(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}]', '', 'g')"


def entropy(x: str) -> str:
    chars = f"string_split({x}, '')"
    return f"CASE WHEN length({x}) > 0 THEN -list_sum(list_transform(list_distinct({chars}), lambda c: (len(list_filter({chars}, lambda y: y = c)) / length({x})) * log2(len(list_filter({chars}, lambda y: y = c)) / length({x})))) ELSE 0.0 END"


def mash(x: str) -> str:
    grams = sorted({r[i : i + 4] for row in KEYBOARD_ROWS for r in (row, row[::-1]) for i in range(len(row) - 3)})
    return f"coalesce(regexp_matches({letters(x)}, {q('|'.join(grams))}), false)"


def bot(x: str) -> str:
    v, a = f"trim({x})", letters(f"trim({x})")
    return f"coalesce(CASE WHEN length({v}) < {ENTROPY_LENGTH} THEN {mash(v)} ELSE {a} <> '' AND ({entropy(a)} >= {ENTROPY_HIGH} AND len(list_distinct(string_split({a}, ''))) >= {ENTROPY_LETTERS} OR {mash(v)}) END, false)"


def sector_text(company: str, domain: str) -> str:
    return classify_text(f"concat_ws(' ', nullif({company}, ''), nullif(split_part({domain}, '.', 1), ''))")


def sector_scores(t: str) -> str:
    """Of a list of tokens: a list of (score, -order, name)."""
    out = []
    for order, (name, words) in enumerate(SECTORS.items()):
        score = f"len(list_filter({t}, lambda x: x IN {listed(words.split())}))"
        for p in PHRASES.get(name, ()):
            score += f" + 2 * len(list_filter(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1] = {q(p)}))"
        out.append(f"{{'score': {score}, 'first': -{order}, 'name': {q(name)}}}")
    return "[" + ", ".join(out) + "]"


def sector_sql(source: str, company: str, domain: str, keep: str) -> str:
    """A query with keep, sector and confidence."""
    return (
        f"SELECT {keep}, CASE WHEN b.score > 0 THEN b.name ELSE {q(NO_SECTOR)} END AS sector, CAST(CASE WHEN b.score > 0 THEN least(100, b.score * 25) ELSE 0 END AS INT) AS confidence FROM "
        f"(SELECT *, list_sort({sector_scores('t')})[-1] AS b FROM (SELECT *, {tokens('s')} AS t FROM (SELECT *, {sector_text(company, domain)} AS s FROM {source})))"
    )


def hmac(x: str, key: bytes) -> str:
    blob = lambda b: "'" + "".join(f"\\x{v:02X}" for v in b) + "'::BLOB"
    inner, outer = pads(key)
    return f"sha256({blob(outer)} || unhex(sha256({blob(inner)} || encode({x}))))"


def soundex(x: str) -> str:
    u = rf"regexp_replace(upper({x}), '[^\p{{L}}]', '', 'g')"
    codes = f"regexp_replace(translate({u}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), '[^0-9]', '0', 'g')"
    for d in "0123456":
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN length({u}) > 0 THEN rpad({u}[1] || replace({codes}[2:], '0', ''), 4, '0')[1:4] END"


def json_text(pairs: dict[str, str]) -> str:
    """A JSON object of strings, without those that are null; names in order."""
    parts = ", ".join(f"""'"{n}":"' || {x} || '"'""" for n, x in sorted(pairs.items()))
    return f"'{{' || array_to_string(list_filter([{parts}], lambda p: p IS NOT NULL), ',') || '}}'"


def merkle(leaves: str, levels: int = 20) -> str:
    """CTEs up to m{levels}, whose one row (h) is the root of a query of (i, h), i from 0, of up to 2^levels leaves."""
    out = [f"m0 AS MATERIALIZED ({leaves})"]
    for k in range(levels):
        out.append(f"m{k + 1} AS MATERIALIZED (SELECT i // 2 AS i, CASE WHEN (SELECT count(*) FROM m{k}) = 1 THEN min(h) ELSE sha256(arg_min(h, i) || arg_max(h, i)) END AS h FROM m{k} GROUP BY i // 2)")
    return ", ".join(out)
