"""SQL that must agree with the text queries, for those that plain SQL can express."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = r"\x20\x09-\x0D"

#: Repeats are windows of three words that stand twice in a text; other rules follow the base rules.
OP3 = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parted AS (
  SELECT r, doc_id, text,
         list_filter(string_split_regex(text, '[{_BLANKS}]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{_BLANKS}]')) AS lines
  FROM texts),
placed AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM parted),
windows AS (
  SELECT r, i, w || ' ' || lead(w, 1) OVER (PARTITION BY r ORDER BY i)
                 || ' ' || lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w3
  FROM placed),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, w3) AS times FROM windows WHERE w3 IS NOT NULL),
repeated AS (
  SELECT r, count(DISTINCT i + s) AS n
  FROM counted, (VALUES (0), (1), (2)) shifts(s) WHERE times > 1 GROUP BY r),
measured AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[{_BLANKS}]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         CAST(len(lines) - list_unique(lines) AS BIGINT) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM parted LEFT JOIN repeated USING (r)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 5 * n_words <= 2 * word_chars
         AND word_chars <= 12 * n_words AND 2 * n_dup_lines <= n_lines AS kept
FROM based"""


def _sized(text: str) -> str:
    """A value with its length in bytes, a null as ``-``."""
    return f"coalesce(strlen(CAST({text} AS VARCHAR)) || ':' || CAST({text} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_sized, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_RUN = "OVER (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN {} AND {})"
_BEFORE, _AFTER = _RUN.format("UNBOUNDED PRECEDING", "1 PRECEDING"), _RUN.format("1 FOLLOWING", "UNBOUNDED FOLLOWING")


def _levels(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (tree, pos, h), and each run's nodes beside a node."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8, n),
{name}_runs AS (
  SELECT tree, level, pos, coalesce(string_agg(h, '') {_BEFORE}, '') AS ahead,
         coalesce(string_agg(h, '') {_AFTER}, '') AS behind
  FROM {name} WHERE n > 1)"""


def _walk(name: str, start: str, runs: str) -> str:
    """From ``start`` (r, tree, pos, proof, claim) up to the root."""
    return f"""
{name}_steps AS (
  SELECT r, tree, 0 AS level, pos, proof, claim FROM {start}
  UNION ALL
  SELECT s.r, s.tree, s.level + 1, s.pos // 8, s.proof || ahead || behind, sha256(ahead || s.claim || behind)
  FROM {name}_steps s JOIN {runs} u ON u.tree = s.tree AND u.level = s.level AND u.pos = s.pos),
{name} AS (SELECT r, arg_max(proof, level) AS proof, arg_max(claim, level) AS claim FROM {name}_steps GROUP BY r)"""


#: CRC-32 of the digits of an id, bit by bit with the reflected polynomial 0xEDB88320.
_CRC = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP11 = f"""
WITH RECURSIVE hashed AS (
  SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {_leaf('text')} AS h,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_LETTERS}', '{_LETTERS.lower()}')")}
              ELSE {_leaf('text')} END AS claim
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM hashed),
{_levels('nodes', 'leaves')},
subroots AS (SELECT -1 AS tree, tree AS pos, h FROM nodes WHERE n = 1),
{_levels('tops', 'subroots')},
opened AS (SELECT r, tree, pos, '' AS proof, claim FROM leaves),
{_walk('within', 'opened', 'nodes_runs')},
between_trees AS (SELECT r, -1 AS tree, l.tree AS pos, w.proof, w.claim FROM within w JOIN leaves l USING (r)),
{_walk('whole', 'between_trees', 'tops_runs')}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256,
       w.claim AS folded_root, w.claim = t.h AS verified
FROM leaves l JOIN whole w USING (r) JOIN subroots s ON s.pos = l.tree, (SELECT h FROM tops WHERE n = 1) t"""

ORACLES = {"op3_quality_cascade": OP3, "op11_merkle_witnesses": OP11}
