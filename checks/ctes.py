"""SQL form of the fixtures and of the shared steps, as named CTEs."""

from __future__ import annotations

from factfeed.config import (
    CONTEXT_PHRASES,
    INFORMATIVE_MAP,
    PARAGRAPH_SENTINEL,
    REFUSAL_PHRASES,
    STOP_WORDS,
    VERDICTS,
    VERIFICATION_MAP,
)

from .fixtures import ASSESS_TEXTS, HEX, PHRASES, VERIFY_TEXTS

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENTENCE = r"[^.!?\n]+[.!?]*"
NL = "chr(10)"
US = "chr(31)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def mapping(col: str, values: dict[str, float]) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in values.items())
    return f"(CASE {col} {whens} END)"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sents(x: str) -> str:
    """List of trimmed sentences."""
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '{SENTENCE}'), lambda s: {strip('s')}), lambda s: s <> '')"
    )


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def no_stops(x: str) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({items(STOP_WORDS)}, w))"


def escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def digit(x: str, at: int) -> str:
    return f"(strpos('{HEX}', substr({x}, {at}, 1)) - 1)"


def any_of(col: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(p)})" for p in phrases) + ")"


def refusal(col: str) -> str:
    return f"({any_of(col, REFUSAL_PHRASES)} OR ends_with({col}, '?'))"


VERDICT_SQL = f"""CASE WHEN contains(lower(text), 'correct') THEN 'Correct'
  WHEN contains(lower(text), 'vague') THEN 'Vague'
  WHEN contains(lower(text), 'wrong') THEN 'Wrong'
  WHEN {any_of('text', CONTEXT_PHRASES)} THEN 'Vague' END"""
GRADE_SQL = "CASE " + " ".join(f"WHEN contains(text, '{g}') THEN '{g}'" for g in "12345") + " END"
INFO_VALUE = mapping("assess", INFORMATIVE_MAP)
TRUTH = f"({mapping('verify', VERIFICATION_MAP)} * abs({INFO_VALUE}))"
INFO = f"ln(greatest(-0.9, sum({INFO_VALUE})) + 1)"

DOC_TITLE = "'Doc & ' || (CASE WHEN doc_id % 37 = 0 THEN greatest(doc_id - 1, 0) ELSE doc_id END)::VARCHAR"
QUESTION = f"{strip('{first}')} || CASE WHEN {{id}} % 3 <> 0 THEN '?' ELSE '' END"

# name -> (names it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


cte("qa", (), """SELECT u.conv_id * 1000 + u.turn AS qid, u.conv_id, u.turn,
  u.text || CASE WHEN (u.conv_id * 1000 + u.turn) % 3 <> 0 THEN '?' ELSE '' END AS question,
  a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
cte("answers", ("qa",), f"SELECT qid AS answer_id, qid, question, {strip('answer')} AS answer FROM qa")
cte("evidence", ("qa",), f"""SELECT u.qid, (doc_id // n)::INTEGER AS mat_no,
  CASE WHEN (doc_id // n) % 2 = 1 THEN {DOC_TITLE} ELSE '' END AS title, text AS material
FROM documents, (SELECT count(*) AS n FROM qa) c
JOIN (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS no FROM qa) u ON u.no = doc_id % n""")
cte("records", ("qa", "evidence"), """SELECT qa.qid, question, titles, materials,
  CASE WHEN qa.qid % 5 <> 0 THEN extra_materials END AS extra_materials
FROM qa JOIN (SELECT qid,
    coalesce(list(title ORDER BY mat_no) FILTER (mat_no % 2 = 1), []) AS titles,
    coalesce(list(material ORDER BY mat_no) FILTER (mat_no % 2 = 0), []) AS materials,
    coalesce(list(material ORDER BY mat_no) FILTER (mat_no % 2 = 1), []) AS extra_materials
  FROM evidence GROUP BY qid) e ON e.qid = qa.qid""")

cte("docs", (), f"""SELECT {escape(DOC_TITLE)} AS title,
  '<s>' || replace(text, {NL}, {lit(PARAGRAPH_SENTINEL)}) || '</s>' AS text FROM documents""")
cte("store", ("docs",), f"""SELECT title AS skey,
  replace(replace(replace(any_value(text), {lit(PARAGRAPH_SENTINEL)}, ''), '<s>', ''), '</s>', '') AS body
FROM docs GROUP BY title HAVING count(*) = 1""")
_first = f"regexp_extract_all(text, '{SENTENCE}')[1]"
cte("qa_span", (), f"""SELECT doc_id AS qid, {escape(DOC_TITLE)} AS title, text AS context,
  {QUESTION.format(first=_first, id='doc_id')} AS question,
  CASE WHEN doc_id % 4 = 0 THEN [] ELSE [regexp_extract(text, '^([^\\s]+)', 1)] END AS answers
FROM documents""")
cte("qa_context", (), f"""SELECT d.doc_id AS qid,
  {QUESTION.format(first='d.s[1]', id='d.doc_id')} AS question,
  regexp_extract(d.text, '^([^\\s]+)', 1) AS answer,
  [d.t, coalesce(e.t, d.t), coalesce(f.t, d.t)] AS ctitles,
  [d.s, coalesce(e.s, d.s), coalesce(f.s, d.s)] AS csents,
  [CASE WHEN d.doc_id % 41 = 0 THEN 'Missing & ' || d.doc_id ELSE coalesce(e.t, d.t) END, d.t,
   CASE WHEN d.doc_id % 41 = 0 THEN 'Missing & ' || d.doc_id ELSE coalesce(e.t, d.t) END] AS facts
FROM docx d LEFT JOIN docx e ON e.doc_id = d.doc_id + 1 LEFT JOIN docx f ON f.doc_id = d.doc_id + 2""")
cte("docx", (), f"""SELECT doc_id, text, {DOC_TITLE} AS t, regexp_extract_all(text, '{SENTENCE}') AS s
FROM documents""")
CTES["qa_context"] = (("docx",), CTES["qa_context"][1])
cte("page_titles", (), """SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS topic
FROM pages""")
cte("topics", (), f"""SELECT doc_id AS qid, 'Tell me about ' || {escape(DOC_TITLE)} AS input,
  {escape(DOC_TITLE)} AS topic FROM documents""")

# ---- extraction texts and their grammar ------------------------------------
_at = "((conv_id + i - 1) % 13)"
_said = f"""CASE WHEN v = 4 AND i = 1 THEN s || '?'
  WHEN (conv_id + i - 1) % 12 = 0 AND {_at} = 12 THEN s || '?'
  WHEN (conv_id + i - 1) % 12 = 0 THEN ({items(PHRASES)})[{_at} + 1] || ' ' || s
  WHEN (conv_id + i - 1) % 7 = 3 THEN regexp_replace(s, '^([^ ]*) ', '\\1 so ')
  ELSE s END"""
_bullet = "CASE WHEN v = 6 THEN '- ' ELSE '* ' END"
_block = f"""'>> Sentence ' || i || ': ' || s || {NL} || {_bullet} || s || {NL}
  || CASE WHEN v = 3 THEN {_bullet} || s || {NL} ELSE '' END
  || CASE WHEN contains(s, ',') THEN {_bullet} || split_part(s, ',', 1) || {NL} ELSE '' END
  || CASE WHEN v = 5 THEN {NL} ELSE '' END"""
cte("said", ("qa",), f"""SELECT answer_id, v, list_transform(ss, lambda s, i: {_said}) AS said
FROM (SELECT qid AS answer_id, conv_id, (conv_id * 3 + turn) % 10 AS v, {sents(strip('answer'))} AS ss FROM qa)""")
cte("good", ("said",), f"""SELECT answer_id, v,
  CASE WHEN v = 5 THEN 'Here are the claims:' || {NL} || {NL} WHEN v = 8 THEN 'Sure. ' ELSE '' END
  || array_to_string(list_transform(said, lambda s, i: {_block}), '')
  || CASE WHEN v = 9 THEN 'That is all.' || {NL} ELSE '' END AS good FROM said""")
cte("extractions", ("good",), f"""SELECT answer_id, attempt::INTEGER AS attempt,
  CASE WHEN v = 0 THEN 'No statements'
    WHEN v = 1 AND attempt = 0 THEN 'Here is a broken list'
    WHEN v = 2 THEN good || 'Note:' || {NL} || good
    WHEN v = 7 AND attempt < 4 THEN '???'
    ELSE good END AS text
FROM (SELECT *, unnest(range(CASE v WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 7 THEN 5 ELSE 1 END)) AS attempt FROM good)""")
cte("ex_lines", ("extractions",), f"""SELECT *,
  CASE WHEN no < n AND regexp_matches(line, '^>> Sentence [0-9]+:[^\\n]') THEN 'h'
    WHEN regexp_matches(line, '^[*-][^\\n]') THEN
      CASE WHEN no < n AND regexp_matches(line, '>> Sentence [0-9]+:[^\\n]') THEN 'x' ELSE 'b' END
    WHEN no < n AND regexp_matches(line, '>> Sentence [0-9]+:[^\\n]') THEN 'm' ELSE 'o' END AS kind
FROM (SELECT answer_id, attempt, text, len(string_split(text, {NL})) AS n,
        unnest(string_split(text, {NL})) AS line, unnest(range(1, len(string_split(text, {NL})) + 1)) AS no
      FROM extractions) WHERE line <> ''""")
cte("ex_groups", ("ex_lines",), """SELECT *,
  sum(CASE WHEN kind <> 'b' THEN 1 ELSE 0 END) OVER (PARTITION BY answer_id, attempt ORDER BY no) AS grp FROM ex_lines""")
cte("ex_open", ("ex_groups",), """SELECT *, coalesce(max(CASE WHEN kind IN ('h', 'm', 'x') THEN 1 ELSE 0 END)
    OVER (PARTITION BY answer_id, attempt, grp), 0) AS inside FROM ex_groups""")
cte("ex_runs", ("ex_open",), """SELECT *, sum(begins) OVER (PARTITION BY answer_id, attempt ORDER BY no) AS run
FROM (SELECT *, CASE WHEN kind = 'm' OR (kind IN ('h', 'x') AND coalesce(lag(inside) OVER
    (PARTITION BY answer_id, attempt ORDER BY no), 0) = 0) THEN 1 ELSE 0 END AS begins FROM ex_open)""")
cte("ex_heads", ("ex_runs",), f"""SELECT *, CASE WHEN inside = 1 AND (begins = 1 OR kind = 'h') THEN
    list_filter(list_transform(string_split_regex(regexp_extract(line, '>> Sentence [0-9]+:[^\\n]+'),
      '>> Sentence [0-9]+:'), lambda p: {strip('p')}), lambda p: p <> '') END AS names FROM ex_runs""")
cte("ex_status", ("extractions", "ex_heads"), """SELECT e.answer_id, e.attempt,
  CASE WHEN coalesce(h.runs, 0) = 1 AND h.good THEN 'ok'
    WHEN coalesce(h.runs, 0) = 0 AND contains(lower(e.text), 'no')
      AND (contains(lower(e.text), 'statement') OR contains(lower(e.text), 'sentence')) THEN 'empty'
    ELSE 'malformed' END AS status
FROM extractions e LEFT JOIN (SELECT answer_id, attempt, sum(begins) AS runs,
    bool_and(names IS NULL OR len(names) = 1) AS good FROM ex_heads GROUP BY ALL) h
  ON h.answer_id = e.answer_id AND h.attempt = e.attempt""")
cte("ex_pairs", ("ex_heads", "ex_status"), f"""SELECT answer_id, attempt, no, sentence, statement
FROM (SELECT h.answer_id, h.attempt, h.no, h.names, {strip('substr(h.line, 2)')} AS statement,
    last_value(h.names[1] IGNORE NULLS) OVER (PARTITION BY h.answer_id, h.attempt ORDER BY h.no) AS sentence
  FROM ex_heads h JOIN ex_status s ON s.answer_id = h.answer_id AND s.attempt = h.attempt AND s.status = 'ok'
  WHERE h.inside = 1 AND h.run = 1)
WHERE names IS NULL""")
cte("stmts", ("ex_pairs", "ex_status"), """SELECT DISTINCT p.answer_id, sentence, statement FROM ex_pairs p
JOIN (SELECT answer_id, min(attempt) AS attempt FROM ex_status WHERE status <> 'malformed' AND attempt < 4
      GROUP BY answer_id) f ON f.answer_id = p.answer_id AND f.attempt = p.attempt""")
cte("tasks", ("stmts",), f"""SELECT answer_id, sentence, statement, task,
  md5(answer_id || {US} || sentence || {US} || statement || {US} || task) AS task_id
FROM stmts, (VALUES ('verify'), ('assess')) t(task)""")
cte("completions", ("tasks",), f"""SELECT task_id, task, attempt::INTEGER AS attempt,
  CASE WHEN task = 'verify' THEN
    CASE WHEN d = 6 AND attempt = 1 THEN 'Wrong' WHEN d = 7 AND attempt = 4 THEN 'Correct'
      ELSE ({items(VERIFY_TEXTS)})[d + 1] END
  ELSE CASE WHEN d = 6 AND attempt = 1 THEN '4' WHEN d = 7 AND attempt = 4 THEN '5'
      ELSE ({items(ASSESS_TEXTS)})[d + 1] END END AS text
FROM (SELECT *, unnest(range(CASE WHEN d = 6 THEN 2 WHEN d IN (7, 12, 14) THEN 5 ELSE 1 END)) AS attempt
      FROM (SELECT task_id, task, {digit('task_id', 1)} AS d FROM tasks))""")
cte("parsed_labels", ("completions",), f"""SELECT *,
  CASE WHEN task = 'verify' THEN {VERDICT_SQL} ELSE {GRADE_SQL} END AS label FROM completions""")
cte("resolved", ("tasks", "parsed_labels"), """SELECT t.*, coalesce(p.label,
    CASE WHEN t.task = 'verify' THEN 'Vague' ELSE '1' END) AS label
FROM tasks t LEFT JOIN (SELECT task_id, arg_min(label, attempt) AS label FROM parsed_labels
    WHERE label IS NOT NULL AND attempt < 4 GROUP BY task_id) p ON p.task_id = t.task_id""")
cte("paired", ("resolved",), """SELECT answer_id, sentence, statement,
  max(label) FILTER (task = 'verify') AS verify, max(label) FILTER (task = 'assess') AS assess
FROM resolved GROUP BY answer_id, sentence, statement""")
_h = f"md5(answer_id || {US} || sentence || {US} || statement)"
cte("labels_h", ("stmts",), f"""SELECT answer_id, sentence, statement,
  ({items(VERDICTS)})[{digit(_h, 1)} % 5 + 1] AS verify, ({digit(_h, 2)} % 5 + 1)::VARCHAR AS assess FROM stmts""")
cte("claims", ("labels_h",), f"SELECT * FROM labels_h WHERE NOT {refusal('sentence')}")
cte("outputs", ("answers",), """SELECT answer_id, answer,
  list_append(regexp_extract_all(answer, ' *[^ ]+'), '</s>') AS tokens FROM answers""")
cte("spine", ("outputs",), """SELECT answer_id, no - 1 AS tok_no, tok,
  sum(length(tok)) OVER (PARTITION BY answer_id ORDER BY no) AS cum, n
FROM (SELECT answer_id, len(tokens) AS n, unnest(tokens) AS tok, unnest(range(1, len(tokens) + 1)) AS no FROM outputs)""")

# ---- rollouts, vectors -----------------------------------------------------
cte("rollouts", (), """SELECT user_id * 1000000 + no // 64 AS seq_id, no % 64 AS tok_no,
  (event_id % 32000)::INTEGER AS token, (-(floor(value)::BIGINT % 5))::DOUBLE AS logp,
  (-(event_id % 5))::DOUBLE AS ref_logp, (event_id % 11) / 10.0::DOUBLE AS value,
  (floor(value)::BIGINT % 7 - 3)::DOUBLE AS reward,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS mask, (user_id % 5 + 1)::INTEGER AS prompt_len
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS no FROM events)""")
cte("seqs", ("rollouts",), """SELECT seq_id,
  list_transform(range(1, any_value(prompt_len) + 1), lambda i: (seq_id % 30000 * 10 + i)::INTEGER) AS prompt_ids,
  list(token ORDER BY tok_no) AS output_ids, list(reward ORDER BY tok_no) AS rewards
FROM rollouts GROUP BY seq_id""")
cte("batched", ("seqs",), """SELECT *, (no // 8) AS batch_id, (no % 8)::INTEGER AS pos
FROM (SELECT *, row_number() OVER (ORDER BY seq_id) - 1 AS no FROM seqs)""")
cte("shaped", ("rollouts",), """SELECT *,
  greatest(-2, least(2, reward)) - 0.01 * kl AS shaped
FROM (SELECT *, exp((logp - ref_logp) * mask) - 1 - (logp - ref_logp) * mask AS kl FROM rollouts)""")

# ---- retrieval -------------------------------------------------------------
cte("queries", ("tasks", "answers"), f"""SELECT a.qid, t.task_id AS query_id,
  CASE WHEN {digit('t.task_id', 2)} < 2 THEN '' ELSE t.statement END AS statement,
  CASE WHEN {digit('t.task_id', 2)} <> 0 THEN a.question END AS question
FROM tasks t JOIN answers a ON a.answer_id = t.answer_id WHERE t.task = 'verify'""")
cte("mat_sents", ("evidence",), f"""SELECT qid, mat_no, title, no, sent, len({tokens('sent')}) AS words
FROM (SELECT qid, mat_no, title, unnest({sents('material')}) AS sent,
        unnest(range(1, len({sents('material')}) + 1)) AS no FROM evidence)""")
cte("sec_fold", ("mat_sents",), """SELECT qid, mat_no, title, 1 AS no, sent, 0 AS i,
    CASE WHEN words > 64 THEN 0 ELSE words END AS total, (words > 64) AS full_here
  FROM mat_sents WHERE no = 1
  UNION ALL
  SELECT m.qid, m.mat_no, m.title, f.no + 1, m.sent, f.i + CASE WHEN f.full_here THEN 1 ELSE 0 END,
    CASE WHEN f.total + m.words > 64 THEN 0 ELSE f.total + m.words END, f.total + m.words > 64
  FROM sec_fold f JOIN mat_sents m ON m.qid = f.qid AND m.mat_no = f.mat_no AND m.no = f.no + 1""")
cte("secs", ("sec_fold",), f"""SELECT qid, mat_no::BIGINT * 4294967296 + i AS sec_no,
  CASE WHEN done AND title <> '' THEN '<' || title || '> ' || body ELSE body END AS section,
  CASE WHEN done AND title <> '' THEN list_concat({no_stops(tokens('title'))}, {tokens('body')})
    ELSE {tokens('body')} END AS tokens
FROM (SELECT qid, mat_no, title, i, bool_or(full_here) AS done, string_agg(sent, ' ' ORDER BY no) AS body
      FROM sec_fold GROUP BY qid, mat_no, title, i)""")
cte("qsents", ("queries",), f"""SELECT qid, query_id, (no - 1)::INTEGER AS sent_no, {no_stops(tokens('sent'))} AS tokens
FROM (SELECT qid, query_id, unnest(ss) AS sent, unnest(range(1, len(ss) + 1)) AS no
  FROM (SELECT qid, query_id, CASE WHEN len({sents('statement')}) > 0 THEN {sents('statement')}
          WHEN question IS NOT NULL THEN [question] ELSE [] END AS ss FROM queries))""")
cte("postings", ("secs",), """SELECT qid, sec_no, term, count(*) AS tf
FROM (SELECT qid, sec_no, unnest(tokens) AS term FROM secs) GROUP BY ALL""")
cte("sec_stats", ("secs",), "SELECT qid, count(*) AS n, avg(len(tokens)) AS avglen FROM secs GROUP BY qid")
cte("idf0", ("postings", "sec_stats"), """SELECT p.qid, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf
FROM (SELECT qid, term, count(*) AS df FROM postings GROUP BY ALL) p JOIN sec_stats s ON s.qid = p.qid""")
cte("idf", ("idf0",), """SELECT i.qid, term, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf
FROM idf0 i JOIN (SELECT qid, avg(idf) AS mean FROM idf0 GROUP BY qid) m ON m.qid = i.qid""")
# every query sentence against every section, zeros included
cte("dense_scores", ("qsents", "secs", "postings", "sec_stats", "idf"), """SELECT q.qid, q.query_id, q.sent_no, s.sec_no,
  coalesce(round(t.score, 9), 0) AS score, st.n
FROM qsents q JOIN secs s ON s.qid = q.qid JOIN sec_stats st ON st.qid = q.qid
LEFT JOIN (SELECT x.qid, query_id, sent_no, p.sec_no,
    sum(i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(z.tokens) / st.avglen))) AS score
  FROM (SELECT qid, query_id, sent_no, unnest(tokens) AS term FROM qsents) x
  JOIN postings p ON p.qid = x.qid AND p.term = x.term
  JOIN idf i ON i.qid = x.qid AND i.term = x.term
  JOIN sec_stats st ON st.qid = x.qid
  JOIN secs z ON z.qid = p.qid AND z.sec_no = p.sec_no
  GROUP BY ALL) t
ON t.qid = q.qid AND t.query_id = q.query_id AND t.sent_no = q.sent_no AND t.sec_no = s.sec_no""")
cte("masked", ("dense_scores",), """SELECT *, CASE WHEN n <= 2 OR
    rank() OVER (PARTITION BY qid, query_id, sent_no ORDER BY score DESC) <= 2 THEN score ELSE 0 END AS kept
FROM dense_scores""")
cte("fused", ("masked",), """SELECT * FROM (SELECT *,
    row_number() OVER (PARTITION BY qid, query_id ORDER BY score DESC, sec_no)::INTEGER AS place
  FROM (SELECT qid, query_id, sec_no, round(sum(kept), 9) AS score FROM masked GROUP BY ALL))
WHERE place <= 2 AND score <> 0""")
cte("passages", ("fused", "queries", "secs"), f"""SELECT qid, query_id, sec_no, score, place FROM fused
UNION ALL
SELECT qid, query_id, sec_no, NULL, place FROM (SELECT q.qid, q.query_id, s.sec_no,
    row_number() OVER (PARTITION BY q.qid, q.query_id ORDER BY s.sec_no)::INTEGER AS place
  FROM queries q JOIN secs s ON s.qid = q.qid WHERE len({sents('q.statement')}) = 0 AND q.question IS NULL)
WHERE place <= 2""")


def query(body: str, *needs: str, **other: tuple[tuple[str, ...], str]) -> str:
    """Full SQL: the needed CTEs in order, then the body.

    `other` puts (needs, sql) in the place of a CTE, or adds one."""
    ctes = CTES | other
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for need in ctes[name][0]:
                add(need)
            done.append(name)

    for name in needs:
        add(name)
    if not done:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({ctes[n][1]})" for n in done) + "\n" + body


# ---- alignment -------------------------------------------------------------
_longest = """list_max(list_concat([0], list_filter(range(1, length(sentence) - i + 2),
  lambda l: contains(txt, substr(sentence, i, l)))))"""
cte("sentences_in", ("claims", "outputs"), """SELECT DISTINCT c.answer_id, sentence, array_to_string(tokens, '') AS txt
FROM claims c JOIN outputs o ON o.answer_id = c.answer_id""")
cte("starts", ("sentences_in",), f"""SELECT answer_id, sentence, txt, i, {_longest} AS n
FROM (SELECT *, unnest(range(1, length(sentence) + 1)) AS i FROM sentences_in WHERE strpos(txt, sentence) = 0)""")
cte("locs", ("sentences_in", "starts"), """SELECT answer_id, sentence, 0 AS sent_at,
    strpos(txt, sentence) - 1 AS ans_at, length(sentence) AS n
  FROM sentences_in WHERE strpos(txt, sentence) > 0
UNION ALL
SELECT answer_id, sentence, CASE WHEN n = 0 THEN 0 ELSE i - 1 END, CASE WHEN n = 0 THEN 0 ELSE a - 1 END, n
FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, sentence ORDER BY n DESC, a, i) AS rn
      FROM (SELECT *, strpos(txt, substr(sentence, i, n)) AS a FROM starts)) WHERE rn = 1""")


def drop_stop(x: str) -> str:
    return f"CASE WHEN ends_with({x}, '.') THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"


cte("walk", ("claims", "locs"), f"""SELECT c.answer_id, c.sentence, c.statement,
    {drop_stop('c.statement')} AS stat, {drop_stop('c.sentence')} AS sent, l.sent_at, l.ans_at, l.n,
    0 AS k, 0::BIGINT AS pos, 0::BIGINT AS hit
  FROM claims c JOIN locs l ON l.answer_id = c.answer_id AND l.sentence = c.sentence
  UNION ALL
  SELECT answer_id, sentence, statement, stat, sent, sent_at, ans_at, n, k + 1, nxt,
    CASE WHEN nxt BETWEEN sent_at + 1 AND sent_at + n THEN nxt ELSE hit END
  FROM (SELECT *, pos + strpos(substr(sent, pos + 1), substr(stat, k + 1, 1)) AS nxt FROM walk WHERE k < length(stat))""")
cte("anchors", ("walk",), """SELECT answer_id, sentence, statement,
  CASE WHEN hit > 0 THEN (hit - 1 - sent_at + ans_at)::INTEGER END AS anchor FROM walk WHERE k = length(stat)""")
cte("char_points", ("claims", "locs", "anchors"), f"""SELECT answer_id, idx, sum(score) AS score FROM (
    SELECT c.answer_id, any_value(CASE WHEN l.n > 0 THEN l.ans_at + l.n - 1 ELSE -1 END) AS idx, {INFO} AS score
    FROM claims c JOIN locs l ON l.answer_id = c.answer_id AND l.sentence = c.sentence
    GROUP BY c.answer_id, c.sentence
  UNION ALL
    SELECT c.answer_id, a.anchor, {TRUTH} FROM claims c
    JOIN anchors a ON a.answer_id = c.answer_id AND a.sentence = c.sentence AND a.statement = c.statement
    WHERE a.anchor IS NOT NULL)
GROUP BY answer_id, idx""")
cte("token_scores", ("char_points", "spine"), """SELECT answer_id, tok_no, sum(score) AS score FROM (
  SELECT p.answer_id, p.score, least(count(*) FILTER (s.cum <= p.idx), any_value(s.n) - 1) AS tok_no
  FROM char_points p JOIN spine s ON s.answer_id = p.answer_id GROUP BY p.answer_id, p.idx, p.score)
GROUP BY answer_id, tok_no""")
cte("sent_scores", ("claims",), f"""SELECT answer_id, sentence, sum({TRUTH}) + {INFO} AS score
FROM claims GROUP BY answer_id, sentence""")


# ---- question sets ---------------------------------------------------------
FACT = """'The correct answer for "' || replace(substr(question, 1, length(question) - 1), '?', '')
  || '" is "' || {answer} || '".'"""
ASKS = f"(ends_with(question, '?') AND len({tokens('question')}) >= 5)"
_paragraphs = f"list_transform(titles, lambda t: {strip('array_to_string(csents[list_position(ctitles, t)], chr(0))')})"
_paragraphs = _paragraphs.replace("chr(0)", "''")
SPAN_FACT = f"""CASE WHEN len(answers) > 0 THEN {FACT.format(answer='answers[1]')}
  ELSE '"' || question || '" has no correct answer.' END"""

cte("ctx_asked", ("qa_context",), f"""SELECT *, list_sort(list_distinct(facts)) AS titles
FROM qa_context WHERE {ASKS}""")
cte("span_first", ("qa_span",), f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY qid) AS rn
  FROM qa_span WHERE {ASKS}) WHERE rn = 1""")
cte("span_asked", ("span_first",), """SELECT *, [replace(title, '&amp;', '&')] AS titles FROM span_first""")
cte("topic_asked", ("topics",), "SELECT qid, input AS question, [replace(topic, '&amp;', '&')] AS titles FROM topics")


def found(name: str, source: str) -> None:
    """Documents of a question source, in title order."""
    cte(name, (source, "store"), f"""SELECT qid, list(body ORDER BY no) AS extra_materials
FROM (SELECT qid, unnest(titles) AS t, unnest(range(1, len(titles) + 1)) AS no FROM {source}) q
JOIN store s ON s.skey = {escape('q.t')} GROUP BY qid""")


found("ctx_found", "ctx_asked")
found("span_found", "span_asked")
found("topic_found", "topic_asked")
cte("ready_context", ("ctx_asked", "ctx_found"), f"""SELECT a.qid, question, titles,
  list_append({_paragraphs}, {FACT.format(answer='answer')}) AS materials, extra_materials
FROM ctx_asked a JOIN ctx_found f ON f.qid = a.qid WHERE len(titles) = len(extra_materials)""")
cte("ready_span", ("span_asked", "span_found"), f"""SELECT a.qid, question, titles,
  [{strip('context')}, {SPAN_FACT}] AS materials, extra_materials
FROM span_asked a JOIN span_found f ON f.qid = a.qid WHERE len(titles) = len(extra_materials)""")
cte("ready_topic", ("topic_asked", "topic_found"), """SELECT a.qid, question, titles,
  NULL::VARCHAR[] AS materials, extra_materials
FROM topic_asked a JOIN topic_found f ON f.qid = a.qid WHERE len(titles) = len(extra_materials)""")
