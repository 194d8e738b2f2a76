"""The named queries of this subpackage, and their SQL where SQL can tell the result."""

from __future__ import annotations

from ..sources.tables import table
from . import abuse, mixing, overlap, splits, threads, tokenizer, turns


def _tables(*names):
    """Turns a function of the named tables into a query of (spark, folder)."""
    return lambda f: lambda spark, folder: f(*[table(spark, folder, n) for n in names])


TRANSCRIPT_TABLES = ("utterances", "transcripts", "participants")

QUERIES = {
    "p1_found": _tables(*TRANSCRIPT_TABLES)(turns.turns_found),
    "p1_turns": _tables(*TRANSCRIPT_TABLES)(turns.speaker_turns),
    "p2_found": _tables(*TRANSCRIPT_TABLES, "speaker_roles")(threads.faults_found),
    "p4_found": _tables("grammaticality_sheet")(overlap.overlap_found),
    "p4_report": _tables("grammaticality_sheet")(overlap.overlap_report),
    "p5_found": _tables("transcripts", "utterances", "children")(splits.transcript_groups),
    "p5_splits": _tables("transcripts", "utterances", "children")(splits.split_transcripts),
    "p6_ids": _tables("documents")(tokenizer.encode_documents),
    "p7_mix": _tables("documents", "mix_targets")(mixing.mix),
    "p7_shares": _tables("documents", "mix_targets")(mixing.mix_report),
    "p8_found": _tables("documents")(abuse.abusive_found),
    "p8_scores": _tables("documents")(abuse.score_documents),
    "p8_rates": _tables("documents")(abuse.abuse_rates),
    "p2_conversations": _tables(*TRANSCRIPT_TABLES, "speaker_roles")(threads.conversations),
}

def _path_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '[\\s\\x{{a0}}]', '', 'g')), '[\\\\/]+', '/', 'g'), '^[./]+', ''), '\\.cha$', '')"


_LETTERS = "lower(regexp_replace({0}, '[^A-Za-z]', '', 'g'))"

_NEAR = r"""WITH w AS (SELECT row_id, split, source, list_filter(string_split(trim(regexp_replace(translate(lower(coalesce(prev_transcript_clean, '')), '\'\'’‘ʼ＇`´', ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS a,
  list_filter(string_split(trim(regexp_replace(translate(lower(coalesce(transcript_clean, '')), '\'\'’‘ʼ＇`´', ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS b FROM grammaticality_sheet WHERE row_id IS NOT NULL),
l AS (SELECT *, len(a) + len(b) AS n FROM w WHERE len(a) + len(b) >= 8 AND split IN ('train', 'val', 'test')),
t AS (SELECT a, b, any_value(n) AS n, list_reduce(list_transform(list_concat(list_transform(a, lambda x: 'a' || x), list_transform(b, lambda x: 'b' || x)), lambda x: (1::UBIGINT << (hash(x) % 64)::UBIGINT)), lambda p, q: xor(p, q)) AS print, bool_or(split = 'train') AS train, bool_or(split <> 'train') AS held FROM l GROUP BY a, b),
c AS (SELECT x.a AS xa, x.b AS xb, y.a AS ya, y.b AS yb FROM t x JOIN t y ON x.train AND y.held AND y.n BETWEEN x.n - 2 AND x.n + 2 AND bit_count(xor(x.print, y.print)) <= 4),
u AS (SELECT *, list_distinct(list_concat(xa, ya, xb, yb)) AS ws FROM c),
d AS (SELECT xa, xb, ya, yb, levenshtein(spell(xa, ws), spell(ya, ws)) + levenshtein(spell(xb, ws), spell(yb, ws)) AS distance FROM u),
near AS (SELECT x.row_id AS train_row, y.row_id AS held_row, distance FROM d JOIN l x ON x.a = xa AND x.b = xb AND x.split = 'train' JOIN l y ON y.a = ya AND y.b = yb AND y.split <> 'train' WHERE distance <= 2)"""
# A record's words as letters, so that the edit distance of letters is that of words; texts with at most 94 different words between them.
for _c in ("xa", "ya", "xb", "yb"):
    _NEAR = _NEAR.replace(f"spell({_c}, ws)", f"array_to_string(list_transform({_c}, lambda x: chr(CAST(32 + list_position(ws, x) AS INTEGER))), '')")
_NEAR = _NEAR.replace("\\'\\'", "''")

# The other results need code blocks, pointers, grammars, automata or models, which SQL does not express.
ORACLE_SQL: dict[str, str] = {
    "p4_found": f"{_NEAR} SELECT least(train_row, held_row) AS row_id_a, greatest(train_row, held_row) AS row_id_b FROM near",
    "p4_report": f"""{_NEAR}, h AS (SELECT held_row, count(*) AS pairs, bool_or(distance = 0) AS exact FROM near GROUP BY 1)
SELECT split, coalesce(source, 'unknown') AS source, count(*) AS n_rows, count(pairs) AS n_overlapping, count(*) FILTER (WHERE exact) AS n_exact, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS n_pairs FROM grammaticality_sheet g LEFT JOIN h ON h.held_row = g.row_id WHERE split IN ('val', 'test') GROUP BY 1, 2""",
    "p5_found": f"""WITH RECURSIVE c AS (SELECT child_name, {_LETTERS.format("child_name")} AS k FROM children),
named AS (SELECT transcript_file, child_name, corpus FROM utterances UNION SELECT transcript_file, child_name, corpus FROM transcripts),
spelled AS (SELECT {_path_sql("transcript_file")} AS key, {_LETTERS.format("child_name")} AS b, {_LETTERS.format("corpus")} AS co FROM named WHERE transcript_file IS NOT NULL AND child_name IS NOT NULL),
p AS (SELECT DISTINCT key, c.child_name AS child FROM spelled JOIN c ON c.k = CASE WHEN starts_with(b, co) THEN b ELSE co || b END),
e AS (SELECT DISTINCT x.child AS a, y.child AS b FROM p x JOIN p y ON x.key = y.key),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), g AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT t.transcript_file, min(g.m) AS group_name FROM transcripts t LEFT JOIN p ON p.key = {_path_sql("t.transcript_file")} LEFT JOIN g ON g.a = p.child GROUP BY 1""",
}
