"""DuckDB SQL of the queries that SQL can express: quality rules, WARC records, mixing, the conversation trie and the manifest."""

from __future__ import annotations

from . import merkle, mixing, quality, warc

_SPACE = r"[\x20\x09-\x0D]+"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\pZ]*"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(mark: str, text: str = "line") -> str:
    """How often a string stands in a text, without overlaps."""
    return f"(length({text}) - length(replace({text}, '{mark}', ''))) // {len(mark)}"


_SYMBOLS = lambda text: f"length({text}) - length(regexp_replace({text}, '[#*$%&|<>]', '', 'g'))"
_MARKS = "length(line) - length(regexp_replace(line, '[|»›•]', '', 'g'))"
_BOILERPLATE = _quoted("(?i)" + "|".join(quality.BOILERPLATE))
_END = _quoted(r"""[.!?…:;。！？][\x22')\]»”’]*""" + _BLANK + "$")

QUALITY = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
parts AS (SELECT doc_id, i, line, list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda w: w <> '') AS w FROM lines),
sized AS (SELECT *, len(w) AS n, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM parts WHERE len(w) > 0),
judged AS (SELECT *, again OR ({_SYMBOLS("line")}) * 10 > chars OR ({_count("!!")} + {_count("??")}) * 4 >= n + 3 OR (({_MARKS}) >= 2 AND n <= 6 * (1 + {_MARKS}))
  OR (n <= 12 AND regexp_matches(line, {_BOILERPLATE})) OR (n >= 8 AND 5 * len(list_filter(range(1, n), lambda j: w[j] = w[j + 1])) > 2 * n) OR (n < 4 AND NOT regexp_matches(line, {_END})) AS bad FROM sized),
per AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(chars) AS BIGINT) AS word_chars, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_bad_lines,
  CAST(coalesce(sum(chars) FILTER (WHERE bad), 0) AS BIGINT) AS lost_chars FROM judged GROUP BY doc_id),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '') AS w FROM docs),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS win FROM words WHERE len(w) > 8),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id),
base AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST({_SYMBOLS("text")} AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(lost_chars, 0) AS lost_chars FROM docs LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)),
failed AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND lost_chars <= {quality.MAX_LOST} * word_chars AS kept FROM failed"""

WARC = f"""WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]', '', 'g') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}', CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM d"""

MIXING = f"""WITH c AS (SELECT source, count(*) AS n, pow(count(*), {mixing.TEMPER}) AS weight FROM documents GROUP BY source),
m AS (SELECT source, (SELECT sum(n) FROM c) * (weight / (SELECT sum(weight) FROM c) / n) AS rate FROM c),
dr AS (SELECT source, greatest(1, CAST(ceil(rate / {mixing.MAX_MEAN}) AS BIGINT)) AS draws, rate FROM m),
p AS (SELECT source, draws, k, exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1)) AS p FROM (SELECT *, unnest(range(CAST(ceil(rate / draws + 12 * sqrt(rate / draws) + 24) AS BIGINT) + 1)) AS k FROM dr)),
cdf AS (SELECT source, draws, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT doc_id, source, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || i), 1, 13) AS BIGINT) / pow(2, 52) AS u FROM (SELECT doc_id, source, unnest(range(1, draws + 1)) AS i FROM documents JOIN dr USING (source))),
k AS (SELECT doc_id, count(*) AS copies FROM u JOIN cdf ON cdf.source = u.source AND cdf.cdf <= u.u GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, copy, md5('17:' || doc_id || ':' || copy) AS shuffle_key FROM (SELECT d.*, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM documents d JOIN k USING (doc_id))"""


#: The unsigned CRC-32 of an integer's decimal digits, by a table of 256 remainders that the polynomial's rule gives.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY b) AS remainders FROM (SELECT b, list_reduce(list_prepend(b, [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))))"


def _crc32(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, d: xor(remainders[(xor(c, d) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT))"


TRIE = f"""WITH {_CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
asked AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS donor, {_crc32("conv_id")} % 9 AS h FROM own, crc),
made AS (SELECT a.conv_id, list_concat(coalesce(o.turns[1:h], []), a.turns[h + 1:]) AS turns FROM asked a LEFT JOIN own o ON o.conv_id = a.donor),
hit AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM made),
member AS (SELECT conv_id, n, depth, turns[1:depth] AS seq FROM hit),
node AS (SELECT depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM member GROUP BY depth, seq),
kids AS (SELECT seq[1:depth - 1] AS seq, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
each AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN node.depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(seq[node.depth].text)) END AS own FROM node LEFT JOIN kids USING (seq)),
below AS (SELECT unnest(range(depth + 1)) AS top, seq, n_children, own FROM each),
sums AS (SELECT top AS depth, seq[1:top] AS seq, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM below GROUP BY 1, 2)
SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, e.ends_sha256
FROM each e JOIN sums s ON s.depth = e.depth AND s.seq = e.seq LEFT JOIN node p ON p.depth = e.depth - 1 AND p.seq = e.seq[1:e.depth - 1]"""


def _merkle(levels: int) -> str:
    """Trees of up to ``merkle.FAN ** levels`` nodes: a level passes on what stands alone in its tree."""
    fan, value = merkle.FAN, lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in merkle.COLUMNS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, nodes: str) -> list[str]:
        """Tables {name}0, ... of (tree, i, h, before, after), from ``nodes`` (tree, i, h)."""
        out = [f"{name}0r AS ({nodes})"]
        for k in range(levels + 1):
            run = f"OVER (PARTITION BY tree, i // {fan} ORDER BY i"
            sides = ", ".join(f"CASE WHEN total > 1 THEN coalesce(string_agg(h, '') {run} ROWS BETWEEN {rows}), '') ELSE '' END AS {side}" for side, rows in (("before", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("after", "1 FOLLOWING AND UNBOUNDED FOLLOWING")))
            out.append(f"{name}{k} AS (SELECT *, {sides} FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS total FROM {name}{k}r))")
            out.append(f"{name}{k + 1}r AS (SELECT tree, i // {fan} AS i, CASE WHEN any_value(total) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY tree, i // {fan})")
        return out

    docs = f"docs AS (SELECT documents.*, {leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id')} % 3 = 0 THEN {leaf(lower)} END AS claimed FROM documents, crc)"
    rows = "SELECT coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, claimed FROM docs"
    parts = [_CRC_TABLE, docs, f"placed AS ({rows})", *tree("a", "SELECT tree, i, h FROM placed"), f"groups AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS i FROM a{levels}r)", *tree("b", "SELECT '' AS tree, i, h FROM groups")]
    parts.append(f"w0 AS (SELECT p.tree, p.i, p.doc_id, p.h AS leaf, coalesce(claimed, p.h) AS f, '' AS proof, g.i AS place, g.h AS subroot FROM placed p JOIN groups g ON g.name = p.tree)")
    steps = [f"a{k} s ON s.tree = w.tree AND s.i = w.i // {fan**k}" for k in range(levels)] + [f"b{k} s ON s.i = place // {fan**k}" for k in range(levels)]
    for k, step in enumerate(steps):
        parts.append(f"w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN s.total > 1 THEN sha256(s.before || f || s.after) ELSE f END AS f, proof || s.before || s.after AS proof) FROM w{k} w JOIN {step})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM w{len(steps)}, b{levels}r"


MERKLE = _merkle(7)
