"""DuckDB SQL with the same result as each registered query, on the same tables.

Written apart from the Spark code, mostly with list functions where that uses
string functions, so that an error in either shows.
"""

from __future__ import annotations

import re

# Character classes in RE2 syntax.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LB = r"[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

VOCAB_SIZE = 5_000
PAIR = 256


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+\z', '')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def _subject_v1(m: str) -> str:
    line = f"lower(split_part({m}, chr(10), 1))"
    bare = rf"regexp_replace({line}, '^[^\n]+:', '')"
    bare = rf"regexp_replace({bare}, '(#[0-9]{{4,5}})|(\(#[0-9]{{4,5}}\))', '', 'g')"
    return _strip(f"(CASE WHEN suffix({bare}, '.') THEN left({bare}, length({bare}) - 1) ELSE {bare} END)")


def _subject_v2(m: str) -> str:
    line = f"lower(regexp_split_to_array({m}, '{LB}')[1])"
    bare = rf"""regexp_replace({line}, '(r"#[0-9]{{4,5}})|(\(#[0-9]{{4,5}}\))', '', 'g')"""
    return _strip(f"(CASE WHEN suffix({bare}, '.') THEN left({bare}, length({bare}) - 1) ELSE {bare} END)")


def _chore(s: str) -> str:
    return f"({s} LIKE 'merge%' OR {s} LIKE 'bump%' OR {s} LIKE 'rollback%')"


def _tagged(patch: str) -> str:
    return f"""list_transform(list_filter(list_transform(regexp_split_to_array({patch}, '{LB}'),
      lambda l: regexp_replace(l, '@@[^@]*@@', '', 'g')), lambda l: l <> ''),
      lambda l: CASE left(l, 1) WHEN '+' THEN '<add>' || substr(l, 2) WHEN '-' THEN '<del>' || substr(l, 2) ELSE '<ide>' || l END)"""


def _lang_v1(f: str) -> str:
    base = f"regexp_extract({f}, '[^/]*$')"
    return f"""CASE WHEN {base} LIKE '_%.%' THEN CASE regexp_extract({base}, '[.][^.]*$')
      WHEN '.java' THEN 'Java' WHEN '.py' THEN 'Python' WHEN '.js' THEN 'Javascript' WHEN '.php' THEN 'PHP'
      WHEN '.rb' THEN 'Ruby' WHEN '.go' THEN 'Go' WHEN '.md' THEN 'Text' END END"""


def _lang_v2(f: str) -> str:
    return f"""CASE string_split({f}, '.')[-1] WHEN 'java' THEN 'Java' WHEN 'py' THEN 'Python'
      WHEN 'js' THEN 'JavaScript' WHEN 'php' THEN 'PHP' WHEN 'rb' THEN 'Ruby' WHEN 'go' THEN 'Go'
      WHEN 'md' THEN 'Markdown' END"""


def _header_v1(f: str) -> str:
    return f"""CASE WHEN {f}.previous_filename IS NULL THEN '<ide><path>' || {f}.filename
      ELSE '<add><path>' || {f}.filename || chr(10) || '<del><path>' || {f}.previous_filename END"""


def _header_v2(f: str) -> str:
    return f"""CASE WHEN {f}.path_after IS DISTINCT FROM {f}.path_before
      THEN '<add><path>' || coalesce({f}.path_after, 'None') || chr(10) || '<del><path>' || coalesce({f}.path_before, 'None')
      ELSE '<ide><path>' || coalesce({f}.path_before, 'None') END"""


def _serialized(files: str, header) -> str:
    return f"""array_to_string(flatten(list_transform({files}, lambda f:
      list_concat([{header('f')}], {_tagged('f.patch')}))), chr(10))"""


def _hash_number(key: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def _joined(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


_PARSE = """list_transform({words}, lambda w, i: {{'word': w,
  'root': i = 1 AND {n} % 5 <> 0, 'obj': i > 1 AND i - 1 = 1 + {n} % 3 AND {n} % 9 <> 0,
  'tag': CASE WHEN i > 1 THEN 'NN' WHEN {n} % 7 = 0 THEN 'VBD' ELSE 'VB' END,
  'head': CASE WHEN i = 1 OR i - 1 = 1 + {n} % 3 OR {n} % 8 = 0 THEN 0 ELSE 1 + {n} % 3 END}})"""


def _vo(parse: str, governed: str) -> str:
    """Rule over a parse; ``governed`` tests a token t against the object at place o."""
    at = f"list_position(list_transform({parse}, lambda t: t.obj), true)"
    between = f"{parse}[2:{at} - 1]"
    return f"""coalesce(CASE WHEN len({parse}) = 0 OR NOT {parse}[1].root OR {parse}[1].tag <> 'VB' THEN false
      WHEN {at} IS NULL OR {at} = 0 THEN false
      ELSE len(list_filter({between}, lambda t: {governed.format(parse=parse, at=at)})) = len({between}) END, false)"""


_BY_TEXT = "{parse}[t.head + 1].word = {parse}[{at}].word"
_BY_ID = "t.head + 1 = {at}"

DOC_VIEWS = {
    "commits": """
SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS sha, lang AS owner, source AS repo,
  CASE WHEN doc_id % 7 = 0 THEN source || '[bot]' WHEN doc_id % 11 = 0 THEN source || '[BOT]' ELSE 'dev' || CAST(doc_id % 13 AS VARCHAR) END AS author,
  'dev' || CAST(doc_id % 13 AS VARCHAR) AS committer,
  CASE doc_id % 6 WHEN 0 THEN 'fix: ' WHEN 1 THEN 'Merge ' WHEN 2 THEN 'feat(core): x: ' WHEN 3 THEN 'Bump ' ELSE '' END
  || split_part(replace(text, chr(10), ' '), ' ', 1) || ' ' || split_part(replace(text, chr(10), ' '), ' ', 2)
  || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' ' || split_part(replace(text, chr(10), ' '), ' ', 3) || ' ' || split_part(replace(text, chr(10), ' '), ' ', 4) END
  || CASE doc_id % 8 WHEN 0 THEN ' (#1234)' WHEN 1 THEN ' #98765' WHEN 2 THEN '.' WHEN 3 THEN '. ' WHEN 4 THEN ' (#123456)' ELSE '' END
  || chr(10) || chr(10) || text AS message, text
FROM documents""",
    "commit_files": """
SELECT * EXCLUDE (text), list_transform(range(0, doc_id % 3 + 1), lambda i: struct_pack(
  filename := 'src/f' || CAST(i AS VARCHAR) || CASE (doc_id + i * (doc_id % 4)) % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.js' WHEN 3 THEN '.php' WHEN 4 THEN '.rb' WHEN 5 THEN '.go' WHEN 6 THEN '.md' WHEN 7 THEN '.PY' ELSE '' END,
  previous_filename := CASE WHEN doc_id % 10 = 3 THEN 'old/f' || CAST(i AS VARCHAR) || '.py' END,
  status := CASE WHEN doc_id % 10 = 3 THEN 'renamed' ELSE 'modified' END,
  patch := CASE WHEN doc_id % 17 <> 5 THEN '@@ -1,3 +1,4 @@' || CASE WHEN doc_id % 2 = 0 THEN ' def f():' ELSE '' END || chr(10)
    || array_to_string(list_transform(string_split(text, chr(10)), lambda l, j:
      CASE WHEN (j - 1) % 7 = 6 THEN '@@ -' || CAST(j - 1 AS VARCHAR) || ' +' || CAST(j - 1 AS VARCHAR) || ' @@' || CASE WHEN (j - 1) % 2 = 0 THEN ' scope' ELSE '' END || chr(10) ELSE '' END
      || CASE (i + j - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END || l), chr(10))
    || chr(10) || '+' || chr(13) || chr(10) END)) AS files
FROM commits""",
    "file_rows": """
SELECT sha, CAST(i - 1 AS INTEGER) AS file_idx, files[i] AS file
FROM (SELECT sha, files, unnest(range(1, len(files) + 1)) AS i FROM commit_files)""",
    "parsed": f"""
SELECT * EXCLUDE (subject), subject,
  {_PARSE.format(words=_words('subject'), n='doc_id')} AS p1,
  {_PARSE.format(words=_words('subject'), n='(doc_id + 1)')} AS p2
FROM (SELECT *, {_subject_v1('message')} AS subject FROM commits)""",
    "flagged": f"""
SELECT doc_id, sha, owner, repo, author, committer, message, subject, CAST(length(subject) AS INTEGER) AS subject_length,
  {_chore('subject')} AS is_chore, suffix(lower(author), '[bot]') AS is_bot,
  CAST(len({_words('subject')}) AS INTEGER) AS subject_word_count,
  {_vo('p1', _BY_TEXT)} AS vo1, {_vo('p2', _BY_ID)} AS vo2
FROM parsed""",
    "annotated": """
SELECT *, NOT is_bot AND NOT is_chore AND subject_length <= 50 AND subject_word_count > 2 AND (vo1 OR vo2) AS fits
FROM flagged""",
    "langs": f"""
SELECT sha, files, list_transform(files, lambda f: {_lang_v1('f.filename')}) AS langs FROM commit_files""",
    "lang_counts": """
SELECT sha, lang, count(*) AS n FROM (SELECT sha, unnest(langs) AS lang FROM langs) GROUP BY sha, lang""",
    "contents": """
SELECT sha, CASE WHEN bool_or(lang IS NULL) THEN NULL WHEN count(*) > 1 THEN 'Mixed' ELSE max(lang) END AS content_type,
  CASE WHEN bool_or(lang IS NULL) THEN NULL ELSE first(lang ORDER BY n DESC, lang) END AS main_lang
FROM lang_counts GROUP BY sha""",
    "complete": """
SELECT * FROM commit_files WHERE len(list_filter(files, lambda f: f.patch IS NULL)) = 0""",
    "processed": f"""
SELECT c.owner, c.repo, k.content_type, k.main_lang, {_subject_v1('c.message')} AS message, c.sha,
  {_serialized('c.files', _header_v1)} AS patch, CAST(len(c.files) AS INTEGER) AS file_count
FROM complete c JOIN contents k USING (sha) WHERE k.content_type IS NOT NULL""",
    "drilled": f"""
SELECT doc_id, repo AS repository, author, committer, message, sha AS hash,
  list_transform(files, lambda f: struct_pack(content_type := {_lang_v2('f.filename')}, patch := coalesce(f.patch, ''),
    path_before := CASE WHEN doc_id % 10 <> 4 THEN coalesce(f.previous_filename, f.filename) END, path_after := f.filename)) AS files
FROM commit_files
WHERE len(list_filter(files, lambda f: ({_lang_v2('f.filename')}) IS NULL)) = 0""",
    "mixed": """
SELECT *, CASE WHEN len(list_distinct(list_filter(files, lambda f: f.content_type <> 'Markdown').list_transform(lambda f: f.content_type))) > 1 THEN 'PL'
  WHEN len(list_filter(files, lambda f: f.content_type = 'Markdown')) > 0 THEN 'NL_ONLY' ELSE 'NO' END AS mixed_content
FROM drilled""",
    "pairs": """
SELECT doc_id AS example_id, CASE WHEN doc_id % 11 = 0 THEN 'baseline' ELSE 'tuned' END AS model,
  CASE doc_id % 7 WHEN 0 THEN 'Java' WHEN 1 THEN 'Go' WHEN 2 THEN 'PHP' WHEN 3 THEN 'Javascript' WHEN 4 THEN 'Ruby' WHEN 5 THEN 'Python' ELSE 'Text' END AS main_lang,
  1 + doc_id % 3 AS file_count, text AS reference,
  CASE WHEN doc_id % 2 = 1 THEN replace(s, ' the ', ' a ') ELSE s END || CASE WHEN doc_id % 3 = 0 THEN ' extra' ELSE '' END AS prediction
FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN substr(text, instr(text, ' ') + 1) ELSE text END AS s FROM documents)""",
    "gappy": f"""
SELECT sha, CASE WHEN doc_id % 5 <> 1 THEN author END AS author, committer,
  CASE WHEN doc_id % 6 <> 2 THEN {_subject_v1('message')} END AS subject FROM commits""",
    "repo_counts": f"""
SELECT owner, repo, CASE WHEN n % 5 = 0 THEN -1 ELSE n END AS commit_count
FROM (SELECT owner, repo, CAST(sum(len({_words('message')})) AS BIGINT) AS n FROM commits GROUP BY owner, repo)""",
    "predicted": """
SELECT example_id, model, main_lang, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w
FROM (SELECT *, string_split(reference, ' ') AS w FROM pairs)""",
    "scored": """
SELECT model, main_lang, count(*) AS labelled, count(*) FILTER (WHERE (example_id + i - 1) % 3 <> 0) AS correct
FROM predicted WHERE (example_id + i - 1) % 4 <> 0 GROUP BY model, main_lang""",
}


def _bleu_views(tokens) -> dict[str, str]:
    return {
        "toks": f"SELECT *, {tokens('prediction')} AS p, {tokens('reference')} AS r FROM pairs",
        "words_long": """
SELECT example_id, 1 AS s, unnest(range(0, len(p))) AS i, unnest(p) AS g1 FROM toks
UNION ALL SELECT example_id, 0 AS s, unnest(range(0, len(r))) AS i, unnest(r) AS g1 FROM toks""",
        "ahead": """
SELECT example_id, s, g1, lead(g1, 1) OVER w AS g2, lead(g1, 2) OVER w AS g3, lead(g1, 3) OVER w AS g4
FROM words_long WINDOW w AS (PARTITION BY example_id, s ORDER BY i)""",
        "grams": """
SELECT example_id, s, 1 AS n, g1 AS g FROM ahead
UNION ALL SELECT example_id, s, 2, g1 || ' ' || g2 FROM ahead WHERE g2 IS NOT NULL
UNION ALL SELECT example_id, s, 3, g1 || ' ' || g2 || ' ' || g3 FROM ahead WHERE g3 IS NOT NULL
UNION ALL SELECT example_id, s, 4, g1 || ' ' || g2 || ' ' || g3 || ' ' || g4 FROM ahead WHERE g4 IS NOT NULL""",
        "matched": """
SELECT example_id, n, sum(least(cp, cr)) AS m FROM
  (SELECT example_id, n, g, sum(s) AS cp, sum(1 - s) AS cr FROM grams GROUP BY example_id, n, g)
GROUP BY example_id, n""",
        "stats": """
SELECT t.example_id, model, main_lang, file_count,
  coalesce(max(m) FILTER (WHERE n = 1), 0) AS m1, coalesce(max(m) FILTER (WHERE n = 2), 0) AS m2,
  coalesce(max(m) FILTER (WHERE n = 3), 0) AS m3, coalesce(max(m) FILTER (WHERE n = 4), 0) AS m4,
  any_value(len(p)) AS lp, any_value(len(r)) AS lr
FROM toks t LEFT JOIN matched USING (example_id) GROUP BY t.example_id, model, main_lang, file_count""",
    }


_SUMS = ", ".join(
    [f"CAST(sum(m{n}) AS BIGINT) AS m{n}" for n in range(1, 5)]
    + [f"CAST(sum(greatest(lp - {n - 1}, 0)) AS BIGINT) AS t{n}" for n in range(1, 5)]
    + ["CAST(sum(lp) AS BIGINT) AS len_p", "CAST(sum(lr) AS BIGINT) AS len_r"]
)


def _score(smooth: bool) -> str:
    if smooth:
        p = [f"((m{n} + 1.0::DOUBLE) / (t{n} + 1.0::DOUBLE))" for n in range(1, 5)]
    else:
        p = [f"(CASE WHEN t{n} > 0 THEN m{n}::DOUBLE / t{n} ELSE 0 END)" for n in range(1, 5)]
    mean = " + ".join(f"ln({x})" for x in p)
    return f"""CASE WHEN len_r = 0 THEN NULL WHEN len_p = 0 OR least({', '.join(p)}) = 0 THEN 0.0::DOUBLE
      ELSE round(100 * exp(({mean}) / 4) * CASE WHEN len_p > len_r THEN 1 ELSE exp(1 - len_r::DOUBLE / len_p) END, 2) END"""


def _tokens_13a(x: str) -> str:
    for found, put in (
        ("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"),
        ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"),
    ):
        x = f"replace({x}, {found}, {put})"
    x = f"(' ' || {x} || ' ')"
    for pattern, put in (
        (r"([\x{7b}-\x{7e}\x{5b}-\x{60}\x{20}-\x{26}\x{28}-\x{2b}\x{3a}-\x{40}\x{2f}])", r" \1 "),
        (r"([^0-9])([.,])", r"\1 \2 "),
        (r"([.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return _words(x)


_LANGUAGES = ("Java", "Go", "PHP", "Javascript", "Ruby", "Python")


def _pivot(keys: str, score: str, source: str) -> str:
    columns = ", ".join(f"max(score) FILTER (WHERE col = '{c}') AS {c}" for c in ("Overall", *_LANGUAGES))
    return f"SELECT {keys}, {columns} FROM (SELECT {keys}, col, {score} AS score FROM {source}) GROUP BY {keys}"


_MARKED = "(<s>|<pad>|</s>|<unk>|<mask>|<ide>|<add>|<del>|<msg>|<path>)"
_RESERVED = ["<s>", "<pad>", "</s>", "<unk>", "<mask>", "<ide>", "<add>", "<del>", "<msg>", "<path>"]


def _tokens(x: str) -> str:
    return _words(rf"regexp_replace({x}, '{_MARKED}', ' \1 ', 'g')")


_VOCAB_VIEWS = {
    "counted": f"""
SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('patch')}) AS token FROM processed
  UNION ALL SELECT unnest({_tokens('message')}) AS token FROM processed)
WHERE token NOT IN ({', '.join(f"'{t}'" for t in _RESERVED)}) GROUP BY token""",
    "vocab": f"""
SELECT token, CAST(9 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id
FROM (SELECT * FROM counted ORDER BY n DESC, token LIMIT {VOCAB_SIZE})
UNION ALL SELECT unnest([{', '.join(f"'{t}'" for t in _RESERVED)}]) AS token, unnest(range(0, 10))::INTEGER AS id""",
}


def _encoded(text: str, name: str, source: str = "processed") -> dict[str, str]:
    """Views giving (sha, ids) of one text column."""
    return {
        f"{name}_tokens": f"""
SELECT sha, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM (SELECT sha, {_tokens(text)} AS t FROM {source})""",
        name: f"""
SELECT sha, list(coalesce(id, 3) ORDER BY pos) AS ids
FROM {name}_tokens LEFT JOIN vocab USING (token) GROUP BY sha""",
    }


_ENCODED = {
    **_VOCAB_VIEWS,
    **_encoded("patch", "patch_enc"),
    **_encoded("'<msg> ' || message", "prompt_enc"),
    **_encoded("message", "message_enc"),
    "encoded": """
SELECT p.*, coalesce(a.ids, []) AS a, coalesce(b.ids, []) AS b, coalesce(m.ids, []) AS m
FROM processed p LEFT JOIN patch_enc a USING (sha) LEFT JOIN prompt_enc b USING (sha) LEFT JOIN message_enc m USING (sha)""",
}

_ID_PAIRS = {
    "id_pairs": """
SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) + 5 AS INTEGER)) AS a,
  list_transform(string_split(text, chr(10)), lambda w: CAST(length(w) + 5 AS INTEGER)) AS b FROM documents"""
}


def _packed(source: str, key: str, size: int) -> dict[str, str]:
    return {
        "kept": f"SELECT *, a[1:greatest({size} - 4 - len(b), 0)] AS k FROM {source}",
        "packed": f"""
SELECT {key}, len(k) AS ka, len(b) AS kb, {size} - 4 - len(b) >= 0 AND ({size} - 4 - len(b) > 0 OR len(a) <= {size} - 4 - len(b)) AS ok,
  list_concat([0], k, [2, 2], b, [2], list_transform(range(0, greatest({size} - len(k) - len(b) - 4, 0)), lambda x: 1)) AS input_ids
FROM kept""",
        "framed": f"""
SELECT *, ka + 4 AS first_msg, ka + 3 + kb AS end_msg,
  list_transform(range(0, {size}), lambda i: CASE WHEN i < ka + kb + 4 THEN 1 ELSE 0 END) AS attention_mask,
  list_transform(range(0, {size}), lambda i: CASE WHEN i = 0 OR i = ka + 1 OR i = ka + 2 OR i >= ka + 3 + kb THEN 1 ELSE 0 END) AS special
FROM packed WHERE ok""",
        "labelled": f"""
SELECT *, list_transform(range(0, {size}), lambda i: CASE WHEN i >= first_msg AND i < end_msg THEN input_ids[i + 1] ELSE -100 END) AS labels,
  list_transform(range(0, {size}), lambda i: CASE WHEN i >= first_msg AND i < end_msg THEN special[i + 1] ELSE 1 END) AS label_special
FROM framed""",
    }


def _seq2seq(a: str, b: str, source: str, key: str, size: int, target: int) -> dict[str, str]:
    return {
        "cut": f"SELECT {key}, {a}[1:{size - 2}] AS a, {b}[1:{target - 2}] AS b FROM {source}",
        "seq": f"""
SELECT {key}, len(a) + 2 AS attended,
  list_concat([0], a, [2], list_transform(range(0, {size} - len(a) - 2), lambda x: 1)) AS input_ids,
  list_concat([0], b, [2], list_transform(range(0, {target} - len(b) - 2), lambda x: 1)) AS target
FROM cut""",
    }


def _with(views: dict[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in views.items()) + "\n" + select


def _sql(select: str, extra: dict[str, str] | None = None) -> str:
    """The select behind the document views it needs and its own views."""
    views = {**DOC_VIEWS, **(extra or {})}
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in views:
            if name not in needed and _mentions(text, name):
                needed.add(name)
                need(views[name])

    need(select)
    used = {name: sql for name, sql in views.items() if name in needed}
    return _with(used, select) if used else select


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) is not None


def oracle_sql() -> dict[str, str]:
    drill_subject = _subject_v2("message")
    quality = f"""NOT suffix(author, '[bot]') AND NOT {_chore('s')} AND length(s) BETWEEN 1 AND 50 AND len({_words('s')}) >= 3"""
    bleu_13a, bleu_plain = _bleu_views(_tokens_13a), _bleu_views(_words)
    noise = """list_transform(range(0, len(input_ids)), lambda i: CASE WHEN label_special[i + 1] = 0
      THEN md5('5:2:' || CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)) END)"""
    chosen = "CAST('0x' || substr(h, 1, 4) AS BIGINT) < 32768"
    kind = "CAST('0x' || substr(h, 5, 4) AS BIGINT)"
    out = {
        "extract_subject_v1": _sql(f"SELECT sha, {_subject_v1('message')} AS subject FROM commits"),
        "extract_subject_v1_literal": _sql(
            f"""SELECT sha, {_strip("(CASE WHEN suffix(l, '.') THEN left(l, length(l) - 1) ELSE l END)")} AS subject
            FROM (SELECT sha, lower(split_part(message, chr(10), 1)) AS l FROM commits)"""
        ),
        "extract_subject_v2": _sql(f"SELECT sha, {drill_subject} AS subject FROM commits"),
        "message_lengths": _sql(
            f"""SELECT sha, CAST(length(message) AS INTEGER) AS message_length,
            CAST(len({_words('message')}) AS INTEGER) AS message_word_count FROM commits"""
        ),
        "annotate_rules": _sql("SELECT sha, subject, subject_length, is_chore, is_bot, subject_word_count FROM flagged"),
        "is_bot": _sql(
            "SELECT sha, lower(author) LIKE '%[bot]' AS is_bot_v1, author LIKE '%[bot]' AS is_bot_v2 FROM commits"
        ),
        "message_prompt": _sql(
            f"SELECT sha, '<msg> ' || message AS prompt, '<msg> ' || array_to_string({_words('message')}, ' ') AS eval_prompt FROM commits"
        ),
        "source_prompt": _sql("SELECT sha, 'Summarize ' || main_lang || ': ' || patch AS prompt FROM processed"),
        "file_languages": _sql(
            f"""SELECT sha, file_idx, {_lang_v1('file.filename')} AS language_v1, {_lang_v2('file.filename')} AS language_v2,
            CASE WHEN {_lang_v2('file.filename')} = 'JavaScript' THEN 'Javascript' WHEN {_lang_v2('file.filename')} = 'Markdown' THEN 'Other'
              ELSE coalesce({_lang_v2('file.filename')}, 'Other') END AS language_raw, 'Other' AS language_raw_compat FROM file_rows"""
        ),
        "path_header_v1": _sql(f"SELECT sha, file_idx, {_header_v1('file')} AS header FROM file_rows"),
        "path_header_v2": _sql(
            f"""SELECT hash, CAST(i - 1 AS INTEGER) AS file_idx, {_header_v2('files[i]')} AS header
            FROM (SELECT hash, files, unnest(range(1, len(files) + 1)) AS i FROM drilled)"""
        ),
        "tag_patch": _sql(
            f"""SELECT sha, file_idx, CAST(i - 1 AS INTEGER) AS line_idx, t[i] AS line FROM
            (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM
              (SELECT sha, file_idx, {_tagged('file.patch')} AS t FROM file_rows WHERE file.patch IS NOT NULL))"""
        ),
        "serialize_commit_v1": _sql(f"SELECT sha, {_serialized('files', _header_v1)} AS patch FROM complete"),
        "serialize_commit_v2": _sql(f"SELECT hash, {_serialized('files', _header_v2)} AS patch FROM drilled"),
        "gather_files": _sql(f"SELECT sha, {_serialized('files', _header_v1)} AS patch FROM complete"),
        "scrub_special": _sql(
            """SELECT sha, replace(replace(replace(replace(replace(replace(
              replace(replace(replace(patch, ' the ', ' <s> <m<pad>sk> '), ' la ', ' <mask<s>> '), ' und ', '</s>'),
              '<msg>', ''), '<pad>', ''), '<s>', ''), '</s>', ''), '<mask>', ''), '<unk>', '') AS patch FROM processed"""
        ),
        "untag": _sql(
            "SELECT sha, replace(replace(replace(patch, '<del>', '-'), '<add>', '+'), '<ide>', '') AS patch FROM processed"
        ),
        "explode_files": _sql(
            f"""SELECT CASE l WHEN 'JavaScript' THEN 'Javascript' WHEN 'Markdown' THEN 'Other' ELSE coalesce(l, 'Other') END AS language,
              owner, repo, sha, message, f.filename AS path, f.patch AS patch, multi AS is_multipart
            FROM (SELECT *, {_lang_v2('f.filename')} AS l FROM (SELECT *, unnest(files) AS f, len(files) > 1 AS multi FROM commit_files))"""
        ),
        "explode_files_compat": _sql(
            """SELECT 'Other' AS language, owner, repo, sha || '.json' AS sha, message, f.filename AS path, f.patch AS patch, multi AS is_multipart
            FROM (SELECT *, unnest(files) AS f, len(files) > 1 AS multi FROM commit_files)"""
        ),
        "repo_key": _sql("SELECT sha, owner || '-' || repo AS repo_key FROM commits"),
        "requirements_mask": _sql(
            """SELECT sha, fits AS fits_either,
            NOT is_bot AND NOT is_chore AND subject_length <= 50 AND subject_word_count > 2 AND vo1 AS fits_compat FROM annotated"""
        ),
        "commit_quality_filter": _sql(
            f"SELECT sha, s AS subject FROM (SELECT *, {drill_subject} AS s FROM flagged) WHERE {quality} AND (vo1 OR vo2)"
        ),
        "all_files_supported_v1": _sql(
            f"""SELECT sha FROM commit_files WHERE doc_id % 12 <> 0 AND
            len(list_filter(files, lambda f: ({_lang_v1('f.filename')}) IS NULL)) = 0"""
        ),
        "all_files_supported_v2": _sql(
            f"""SELECT sha FROM commit_files WHERE doc_id % 12 = 0 OR
            len(list_filter(files, lambda f: ({_lang_v2('f.filename')}) IS NULL)) = 0"""
        ),
        "complete_patches": _sql("SELECT sha FROM complete"),
        "drop_incomplete_rows": _sql("SELECT * FROM gappy WHERE author IS NOT NULL AND subject IS NOT NULL"),
        "drop_incomplete_columns": _sql("SELECT sha, committer FROM gappy"),
        "single_file": _sql("SELECT sha, file_count FROM processed WHERE file_count = 1"),
        "unmixed": _sql("SELECT sha, content_type FROM processed WHERE content_type <> 'Mixed'"),
        "for_language": _sql("SELECT sha, main_lang FROM processed WHERE main_lang = 'Python'"),
        "drop_null_messages": _sql("SELECT sha, subject AS message FROM gappy WHERE subject IS NOT NULL"),
        "no_merges": _sql("SELECT sha, CAST(doc_id % 4 AS INTEGER) AS n_parents FROM commits WHERE doc_id % 4 <= 1"),
        "reapply_rules": _sql(
            """SELECT sha, subject_length, is_chore, is_bot, subject_word_count, fits AS fits_requirements
            FROM annotated WHERE doc_id % 19 <> 3"""
        ),
        "verb_object_spacy": _sql("SELECT sha, vo1 AS verb_object FROM flagged"),
        "verb_object_stanza": _sql("SELECT sha, vo2 AS verb_object FROM flagged"),
        "with_verb_object": _sql(
            f"""SELECT sha, len(w) >= 3 AND length(w[1]) % 5 <> 0 AS verb_object_spacy,
            len(w) >= 2 AND length(w[1]) % 2 = 0 AS verb_object_stanza FROM (SELECT sha, {_words('subject')} AS w FROM flagged)"""
        ),
        "passing_only": _sql("SELECT owner, repo, sha, message FROM annotated WHERE fits"),
        "pending_units": _sql(
            """SELECT DISTINCT owner, repo FROM commits WHERE (owner, repo) NOT IN
            (SELECT (owner, repo) FROM processed WHERE file_count = 3)"""
        ),
        "diff_fetch_plan": _sql(
            "SELECT owner, repo, sha FROM annotated WHERE fits AND sha NOT IN (SELECT sha FROM complete)"
        ),
        "page_plan_compat": _sql(
            """SELECT owner, repo, CAST(unnest(range(1, CASE WHEN commit_count // 90 + 1 = 1 THEN 2 ELSE commit_count // 90 + 1 END)) AS INTEGER) AS page
            FROM repo_counts WHERE commit_count <> -1"""
        ),
        "page_plan_full": _sql(
            """SELECT owner, repo, CAST(unnest(range(1, (commit_count + 89) // 90 + 1)) AS INTEGER) AS page
            FROM repo_counts WHERE commit_count <> -1"""
        ),
        "last_page": "SELECT page_id, CAST(CASE WHEN page_id % 9 <> 4 THEN page_id ELSE -1 END AS INTEGER) AS last_page FROM pages",
        "quarantine": _sql(
            f"""SELECT c.sha, CASE WHEN c.sha NOT IN (SELECT sha FROM complete) THEN 'patch' WHEN k.content_type IS NULL THEN 'language'
            WHEN length({_subject_v1('c.message')}) > 50 THEN 'subject' ELSE '' END AS reason
            FROM commits c JOIN contents k USING (sha)"""
        ),
        "content_type": _sql("SELECT sha, content_type, main_lang FROM contents"),
        "mixed_content": _sql("SELECT hash, mixed_content FROM mixed"),
        "file_count": _sql("SELECT sha, CAST(len(files) AS INTEGER) AS file_count FROM commit_files"),
        "funnel": _sql(
            """SELECT coalesce(owner, '*') AS owner, coalesce(repo, '*') AS repo, count(*) AS scraped, count(*) AS annotated,
              count(*) FILTER (WHERE NOT is_bot) AS not_bot, count(*) FILTER (WHERE NOT is_chore) AS not_chore,
              count(*) FILTER (WHERE subject_length <= 50) AS short_enough, count(*) FILTER (WHERE subject_word_count > 2) AS enough_words,
              count(*) FILTER (WHERE vo1 OR vo2) AS verb_object, count(*) FILTER (WHERE fits) AS fitting,
              count(*) FILTER (WHERE fits AND sha IN (SELECT sha FROM complete)) AS landed,
              count(*) FILTER (WHERE fits AND sha IN (SELECT sha FROM processed)) AS processed
            FROM annotated GROUP BY ROLLUP (owner, repo)"""
        ),
        "bleu_tokens": _sql(
            rf"""SELECT example_id, array_to_string({_tokens_13a("t")}, ' ') AS tokens FROM
            (SELECT example_id, prediction || ' &amp; 3.5,x-1 (a_b) <skipped>-9 end.' || chr(10) || '&quot;q&quot;' AS t FROM pairs)"""
        ),
        "corpus_bleu": _sql(f"SELECT *, {_score(True)} AS bleu FROM (SELECT {_SUMS} FROM stats)", bleu_13a),
        "corpus_bleu_by_language": _sql(
            f"SELECT *, {_score(False)} AS bleu FROM (SELECT main_lang, {_SUMS} FROM stats GROUP BY main_lang)", bleu_plain
        ),
        "bleu_report": _sql(
            _pivot("model, input", _score(True), "report_rows"),
            {
                **bleu_13a,
                "tagged": """SELECT *, 'Multi File' AS input FROM stats UNION ALL SELECT *, 'Single File' AS input FROM stats WHERE file_count = 1""",
                "report_rows": f"""SELECT model, input, 'Overall' AS col, {_SUMS} FROM tagged GROUP BY model, input
                UNION ALL SELECT model, input, main_lang AS col, {_SUMS} FROM tagged GROUP BY model, input, main_lang""",
            },
        ),
        "masked_accuracy": _sql(
            """SELECT main_lang, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(labelled) AS BIGINT) AS labelled,
            round(sum(correct)::DOUBLE / sum(labelled), 6) AS accuracy FROM scored GROUP BY main_lang"""
        ),
        "accuracy_report": _sql(
            _pivot("model", "round(correct::DOUBLE / labelled, 6)", "accuracy_rows"),
            {
                "accuracy_rows": """SELECT model, 'Overall' AS col, sum(correct) AS correct, sum(labelled) AS labelled FROM scored GROUP BY model
                UNION ALL SELECT model, main_lang AS col, sum(correct), sum(labelled) FROM scored GROUP BY model, main_lang"""
            },
        ),
        "union_repos": _sql("SELECT owner, repo, sha, subject_length, fits AS fits_requirements FROM annotated"),
        "shuffle": _sql("SELECT sha, md5('7:' || sha) AS order_key FROM commits"),
        "split": _sql(
            """SELECT sha, CASE WHEN substr(md5('7:' || sha), 1, 4) < 'cccd' THEN 'train'
            WHEN substr(md5('7:' || sha), 1, 4) < 'e666' THEN 'test' ELSE 'valid' END AS split FROM commits"""
        ),
        "debug_head": _sql(
            """SELECT sha, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha) AS k FROM
            (SELECT sha, CASE WHEN substr(md5('0:' || sha), 1, 4) < 'cccd' THEN 'train'
            WHEN substr(md5('0:' || sha), 1, 4) < 'e666' THEN 'test' ELSE 'valid' END AS split FROM commits)) WHERE k <= 2"""
        ),
        "sample_rows": _sql("SELECT sha, message FROM commits ORDER BY md5('3:' || sha), sha LIMIT 100"),
        "build_vocab": _sql("SELECT token, id FROM vocab", _VOCAB_VIEWS),
        "pack_pair": _sql(
            """SELECT doc_id, CASE WHEN ok THEN array_to_string(input_ids, ' ') ELSE 'quarantined' END AS input_ids,
            coalesce(array_to_string(attention_mask, ' '), 'quarantined') AS attention_mask,
            coalesce(array_to_string(special, ' '), 'quarantined') AS special_tokens_mask
            FROM (SELECT p.doc_id, p.ok, p.input_ids, f.attention_mask, f.special FROM packed p LEFT JOIN framed f USING (doc_id))""",
            {**_ID_PAIRS, **_packed("id_pairs", "doc_id", PAIR)},
        ),
        "message_labels": _sql(
            "SELECT doc_id, array_to_string(labels, ' ') AS labels, array_to_string(label_special, ' ') AS special_tokens_mask FROM labelled",
            {**_ID_PAIRS, **_packed("id_pairs", "doc_id", PAIR)},
        ),
        "pack_seq2seq": _sql(
            """SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids, CAST(attended AS INTEGER) AS attended,
            array_to_string(list_transform(target, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END), ' ') AS labels,
            array_to_string(target, ' ') AS restored FROM seq""",
            {**_ID_PAIRS, **_seq2seq("a", "b", "id_pairs", "doc_id", PAIR, 24)},
        ),
        "mlm_mask": _sql(
            f"""SELECT doc_id, array_to_string(list(CASE WHEN h IS NULL OR NOT {chosen} THEN x
              WHEN {kind} < 52429 THEN 4 WHEN {kind} < 58982 THEN CAST('0x' || substr(h, 9, 8) AS BIGINT) % 500 ELSE x END ORDER BY i), ' ') AS input_ids,
              array_to_string(list(CASE WHEN h IS NOT NULL AND {chosen} THEN x ELSE -100 END ORDER BY i), ' ') AS labels
            FROM (SELECT doc_id, unnest(input_ids) AS x, unnest({noise}) AS h, unnest(range(0, len(input_ids))) AS i FROM labelled) GROUP BY doc_id""",
            {**_ID_PAIRS, **_packed("id_pairs", "doc_id", PAIR)},
        ),
        "mask_one": _sql(
            f"""SELECT doc_id, array_to_string(list_transform(input_ids, lambda x, i: CASE WHEN i - 1 = p THEN 4 ELSE x END), ' ') AS input_ids,
            CAST(p AS INTEGER) AS position, CAST(input_ids[p + 1] AS INTEGER) AS answer FROM
            (SELECT *, first_msg + {_hash_number('doc_id', '5')} % (end_msg - first_msg) AS p FROM labelled WHERE end_msg > first_msg)""",
            {**_ID_PAIRS, **_packed("id_pairs", "doc_id", PAIR)},
        ),
        "mask_one_word": _sql(
            f"""SELECT sha, array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 = {_hash_number('sha', '5')} % len(w) THEN '<mask>' ELSE x END), ' ') AS message
            FROM (SELECT sha, {_words('message')} AS w FROM commits)"""
        ),
        "argmax_ids": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings",
        "subsequence_positions": _sql(
            """SELECT a.doc_id, coalesce(array_to_string(list(DISTINCT p ORDER BY p), ' '), '') AS positions FROM
            (SELECT doc_id FROM documents) a LEFT JOIN
            (SELECT doc_id, 0 AS p FROM id_pairs WHERE len(a) = 1 UNION ALL
             SELECT doc_id, unnest([i - 1, i]) AS p FROM (SELECT doc_id, a, unnest(range(1, len(a))) AS i FROM id_pairs)
              WHERE a[i] = a[1] AND a[i + 1] = a[2]) b USING (doc_id) GROUP BY a.doc_id""",
            _ID_PAIRS,
        ),
        "prepare_mlm": _sql(
            """SELECT p.sha, CASE WHEN p.ok THEN array_to_string(p.input_ids, ' ') ELSE 'quarantined' END AS input_ids,
            coalesce(array_to_string(attention_mask, ' '), 'quarantined') AS attention_mask,
            coalesce(array_to_string(label_special, ' '), 'quarantined') AS special_tokens_mask,
            coalesce(array_to_string(labels, ' '), 'quarantined') AS labels FROM packed p LEFT JOIN labelled l USING (sha)""",
            {
                **_ENCODED,
                "chosen": "SELECT sha, a, b FROM encoded WHERE file_count = 1 AND content_type <> 'Mixed'",
                **_packed("chosen", "sha", PAIR),
            },
        ),
        "prepare_seq2seq": _sql(
            f"""SELECT sha, array_to_string(input_ids, ' ') AS input_ids,
            array_to_string(list_transform(range(0, {PAIR}), lambda i: CASE WHEN i < attended THEN 1 ELSE 0 END), ' ') AS attention_mask,
            array_to_string(list_transform(target, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END), ' ') AS labels FROM seq""",
            {**_ENCODED, **_seq2seq("a", "m", "encoded", "sha", PAIR, 16)},
        ),
        "prepare_debug": _sql(
            """SELECT sha, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha) AS k FROM
            (SELECT *, CASE WHEN substr(md5('0:' || sha), 1, 4) < 'cccd' THEN 'train'
            WHEN substr(md5('0:' || sha), 1, 4) < 'e666' THEN 'test' ELSE 'valid' END AS split FROM processed))
            WHERE k <= 5 AND file_count = 1 AND content_type <> 'Mixed'"""
        ),
        "prepare_eval": _sql(
            f"""SELECT sha, patch, '<msg> ' || array_to_string({_words('message')}, ' ') AS message, main_lang FROM processed"""
        ),
        "prepare_eval_compat": _sql(
            f"""SELECT sha, replace(replace(replace(patch, '<del>', '-'), '<add>', '+'), '<ide>', '') AS patch,
            '<msg> ' || array_to_string({_words('message')}, ' ') AS message, main_lang FROM processed WHERE main_lang = 'Go'"""
        ),
        "repo_list": """SELECT line AS url, CASE WHEN len(p) >= 2 THEN p[-2] ELSE 'quarantined' END AS owner, p[-1] AS repo FROM
            (SELECT line, string_split(line, '/') AS p FROM (SELECT CASE page_id % 10 WHEN 0 THEN '#' || url WHEN 1 THEN url || '/'
              WHEN 2 THEN replace(url, '/', '') ELSE url END AS line FROM pages)) WHERE line NOT LIKE '#%'""",
        "stage_csv_round_trip": _sql(
            """SELECT content_type, main_lang, 'say "' || message || '"' AS message, sha, patch, file_count FROM processed"""
        ),
        "stage_round_trip": _sql("SELECT owner, repo, sha, subject, fits AS fits_requirements FROM annotated"),
        "dataset_round_trip": _sql(
            """SELECT sha, main_lang, patch, CASE WHEN substr(md5('0:' || sha), 1, 4) < 'cccd' THEN 'train'
            WHEN substr(md5('0:' || sha), 1, 4) < 'e666' THEN 'test' ELSE 'valid' END AS split FROM processed"""
        ),
        "annotate_job": _sql(
            f"""SELECT sha, subject, subject_length, is_chore, is_bot, subject_word_count,
            NOT is_bot AND NOT is_chore AND subject_length <= 50 AND subject_word_count > 2
              AND (length(w[1]) % 5 <> 0 OR length(w[1]) % 2 = 0) AS fits_requirements
            FROM (SELECT *, {_words('subject')} AS w FROM flagged)"""
        ),
        "preprocess_job": _sql(
            "SELECT p.* FROM processed p WHERE sha IN (SELECT sha FROM annotated WHERE fits)"
        ),
        "drill_job": _sql(
            f"""SELECT repository, mixed_content, message, hash, {_serialized('files', _header_v2)} AS patch FROM
            (SELECT *, {_vo('p1', _BY_TEXT)} AS vo1, {_vo('p2', _BY_ID)} AS vo2 FROM
              (SELECT *, {_PARSE.format(words=_words('s'), n='doc_id')} AS p1, {_PARSE.format(words=_words('s'), n='(doc_id + 1)')} AS p2
               FROM (SELECT *, {drill_subject} AS s FROM mixed) WHERE {quality})) WHERE vo1 OR vo2"""
        ),
        "drill_job_with_parsers": _sql(
            f"""SELECT hash, mixed_content FROM (SELECT *, {_words('s')} AS w FROM (SELECT *, {drill_subject} AS s FROM mixed) WHERE {quality})
            WHERE length(w[1]) % 5 <> 0 OR length(w[1]) % 2 = 0"""
        ),
        "publish_job": _sql(
            """SELECT content_type, main_lang, message, sha, patch, file_count,
            CASE WHEN substr(md5('7:' || sha), 1, 4) < 'cccd' THEN 'train'
            WHEN substr(md5('7:' || sha), 1, 4) < 'e666' THEN 'test' ELSE 'valid' END AS split
            FROM processed WHERE sha IN (SELECT sha FROM annotated WHERE fits)"""
        ),
        "fitting_by_repo": _sql(
            "SELECT owner, repo, count(*) AS commits, count(*) FILTER (WHERE fits) AS fitting FROM annotated GROUP BY owner, repo"
        ),
    }
    complete_fork = "list_transform(files, lambda f: struct_pack(filename := 'fork/' || f.filename, previous_filename := f.previous_filename, patch := f.patch))"
    out["gather_files_forks"] = _sql(
        f"""SELECT owner || '/' || repo || '/' || sha AS id, {_serialized('files', _header_v1)} AS patch FROM complete
        UNION ALL SELECT owner || '/' || repo || '-fork/' || sha AS id, {_serialized(complete_fork, _header_v1)} AS patch FROM complete"""
    )
    out["corpus_bleu_nulls"] = _sql(
        f"SELECT *, {_score(True)} AS bleu FROM (SELECT {_SUMS} FROM stats)",
        {
            **bleu_13a,
            "pairs": f"""SELECT * REPLACE (CASE WHEN example_id % 7 = 2 THEN '' ELSE prediction END AS prediction)
            FROM ({DOC_VIEWS['pairs']}) WHERE example_id % 9 <> 4""",
        },
    )
    out["masked_accuracy_gaps"] = _sql(
        """SELECT main_lang, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS labelled,
        round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 6) AS accuracy FROM (
          SELECT main_lang, (example_id + i - 1) % 3 <> 0 AND example_id % 5 <> 1
            AND (example_id % 5 <> 2 OR i <= count(*) OVER (PARTITION BY example_id) - 3) AS hit, example_id, i
          FROM predicted) WHERE (example_id + i - 1) % 4 <> 0 GROUP BY main_lang"""
    )
    out["encode_forks"] = _sql(
        """SELECT f.sha AS id, array_to_string(coalesce(a.ids, []), ' ') AS patch_ids, array_to_string(coalesce(b.ids, []), ' ') AS prompt_ids
        FROM forked f LEFT JOIN patch_enc a USING (sha) LEFT JOIN prompt_enc b USING (sha)""",
        {
            **_VOCAB_VIEWS,
            "forked": """SELECT owner || '/' || repo || '/' || sha AS sha, patch, message FROM processed
            UNION ALL SELECT owner || '/' || repo || '-fork/' || sha AS sha, patch, message || ' again' AS message FROM processed""",
            **_encoded("patch", "patch_enc", "forked"),
            **_encoded("'<msg> ' || message", "prompt_enc", "forked"),
        },
    )
    out["drill_job_merges"] = out["drill_job"].replace("WHERE vo1 OR vo2", "WHERE (vo1 OR vo2) AND (doc_id % 5 = 0 OR doc_id % 4 <= 1)")
    out["publish_raw"] = _sql(
        f"""SELECT CASE l WHEN 'JavaScript' THEN 'Javascript' WHEN 'Markdown' THEN 'Other' ELSE coalesce(l, 'Other') END AS language,
          owner, repo, sha, message, f.filename AS path, f.patch AS patch, multi AS is_multipart
        FROM (SELECT *, {_lang_v2('f.filename')} AS l FROM (SELECT *, unnest(files) AS f, len(files) > 1 AS multi FROM commit_files
          WHERE sha IN (SELECT sha FROM annotated WHERE fits)))"""
    )
    out["read_checked"] = _sql(
        """SELECT sha, message, '' AS reason FROM commits WHERE NOT suffix(repo, '7')
        UNION ALL SELECT '' AS sha, '' AS message, 'unreadable' AS reason FROM
          (SELECT DISTINCT owner, repo, doc_id // 512 FROM commits WHERE suffix(repo, '7'))"""
    )
    out["stage_second_run"] = _sql(
        """SELECT owner, repo, sha, 'stored' AS state FROM commits
        UNION ALL SELECT DISTINCT owner, repo, '' AS sha, 'done' AS state FROM commits
        UNION ALL SELECT 'none' AS owner, 'empty' AS repo, '' AS sha, 'done' AS state"""
    )
    out["rerun_rules"] = _sql("SELECT owner, repo, sha, subject FROM flagged WHERE NOT suffix(repo, '1')")
    out["stream_equals_batch"] = _sql(
        """SELECT p.main_lang, p.message, p.patch, '' AS reason FROM processed p JOIN commits c USING (sha) WHERE c.doc_id % 9 <> 4
        UNION ALL SELECT '' AS main_lang, '' AS message, '' AS patch, 'unreadable' AS reason FROM commits WHERE doc_id % 9 = 4"""
    )
    files = "(SELECT DISTINCT owner, repo, doc_id // 512 FROM commits)"
    out["sample_with_replacement"] = _sql(
        """SELECT draw, sha, message FROM
          (SELECT range AS draw, CAST((CAST(CAST('0x' || substr(md5('3:draw:' || range), 1, 15) AS BIGINT) AS HUGEINT) * (SELECT count(*) FROM commits))
             // 1152921504606846976 AS BIGINT) AS place FROM range(1000))
        JOIN (SELECT sha, message, row_number() OVER (ORDER BY md5('3:' || sha), sha) - 1 AS place FROM commits) USING (place)"""
    )
    out["read_top_repos"] = _sql(
        """SELECT lang || '/caf' || chr(233) || '-' || doc_id AS repo, source AS main_branch, CASE WHEN doc_id % 3 = 0 THEN 'JavaScript' ELSE upper(lang) END AS language,
          lang || '-caf' || chr(233) || '-' || doc_id AS repo_id, CASE WHEN doc_id % 3 = 0 THEN 'javascript' ELSE lower(lang) END AS language_dir FROM documents"""
    )
    out["read_api_commits"] = _sql("SELECT sha, author, committer, message FROM commits")
    out["read_raw_diffs"] = _sql(
        """SELECT 'repo_key=' || owner || '-' || repo AS repo_key, message, array_to_string(list_transform(files, lambda f: f.filename), ' ') AS names,
          array_to_string(list_filter(list_transform(files, lambda f: f.patch), lambda p: p IS NOT NULL), chr(10)) AS patches FROM commit_files WHERE doc_id % 9 <> 4
        UNION ALL SELECT 'repo_key=' || owner || '-' || repo AS repo_key, '' AS message, '' AS names, '' AS patches FROM commit_files WHERE doc_id % 9 = 4"""
    )
    out["read_drilled"] = _sql(
        """SELECT repository, hash, mixed_content, message, array_to_string(list_transform(files, lambda f: f.patch), chr(10)) AS patches, '' AS reason
        FROM mixed WHERE NOT suffix(repository, '7')
        UNION ALL SELECT '' AS repository, '' AS hash, '' AS mixed_content, '' AS message, '' AS patches, 'unreadable' AS reason FROM
          (SELECT DISTINCT repository, doc_id // 512 FROM mixed WHERE suffix(repository, '7'))"""
    )
    out["read_drilled_ranges"] = _sql(
        """SELECT repository, hash, mixed_content, message, array_to_string(list_transform(files, lambda f: f.patch), chr(10)) AS patches FROM mixed"""
    )
    out["ledger_runs"] = _sql(
        f"""SELECT owner, repo, sha, 'row' AS state, CASE WHEN right(repo, 1) IN ('3', '7') THEN 2 ELSE 1 END AS run FROM commits
        UNION ALL SELECT '' AS owner, '' AS repo, '' AS sha, 'read' AS state, CASE WHEN right(repo, 1) IN ('3', '7') THEN 2 ELSE 1 END AS run FROM {files}
        UNION ALL SELECT '' AS owner, '' AS repo, '' AS sha, 'was unreadable' AS state, 1 AS run FROM {files} WHERE suffix(repo, '7')"""
    )
    parsed_verb = "(length(w[1]) % 5 <> 0 OR length(w[1]) % 2 = 0)"
    fits_parsed = f"NOT is_chore AND subject_length <= 50 AND subject_word_count > 2 AND {parsed_verb}"
    out["preprocess_files"] = _sql(
        f"""SELECT content_type, main_lang, p.message, patch, file_count, '' AS reason FROM processed p
        JOIN (SELECT *, {_words('subject')} AS w FROM flagged) f USING (sha) WHERE f.doc_id % 9 <> 4 AND {fits_parsed}
        UNION ALL SELECT '' AS content_type, '' AS main_lang, '' AS message, '' AS patch, 0 AS file_count, 'unreadable' AS reason FROM commits WHERE doc_id % 9 = 4"""
    )
    out["run_stages"] = _sql(
        f"""SELECT content_type, main_lang, p.message, patch, file_count FROM processed p
        JOIN (SELECT *, {_words('subject')} AS w FROM flagged) f USING (sha) WHERE {fits_parsed}
        UNION ALL SELECT 'known' AS content_type, 'repo_key=' || owner AS main_lang, subject AS message, '' AS patch, subject_length AS file_count
        FROM (SELECT *, {_words('subject')} AS w FROM flagged) WHERE {fits_parsed}"""
    )
    out["drill_files"] = _sql(
        f"""SELECT repository, mixed_content, message, hash, {_serialized('files', _header_v2)} AS patch, '' AS reason FROM
        (SELECT *, {_words('s')} AS w FROM (SELECT *, {drill_subject} AS s FROM mixed) WHERE {quality})
        WHERE {parsed_verb} AND NOT suffix(repository, '7')
        UNION ALL SELECT '' AS repository, '' AS mixed_content, '' AS message, '' AS hash, '' AS patch, 'unreadable' AS reason FROM
          (SELECT DISTINCT repository, doc_id // 512 FROM mixed WHERE suffix(repository, '7'))"""
    )
    out["publish_files"] = _sql(
        """SELECT 'dataset' AS part, sha, main_lang AS name, message, patch, CASE WHEN substr(md5('7:' || sha), 1, 4) < 'cccd' THEN 'train'
          WHEN substr(md5('7:' || sha), 1, 4) < 'e666' THEN 'test' ELSE 'valid' END AS split
        FROM processed WHERE sha IN (SELECT sha FROM annotated WHERE fits)
        UNION ALL SELECT 'raw' AS part, sha, f.filename AS name, message, coalesce(f.patch, '') AS patch, '' AS split FROM
          (SELECT *, unnest(files) AS f FROM commit_files WHERE sha IN (SELECT sha FROM annotated WHERE fits))
        UNION ALL SELECT 'metadata' AS part, sha, owner AS name, subject AS message, '' AS patch, '' AS split FROM annotated"""
    )
    cheap = "NOT is_bot AND NOT is_chore AND subject_length <= 50 AND subject_word_count > 2"
    out["funnel_of_runs"] = _sql(
        f"""SELECT count(*) AS scraped, count(*) AS annotated, count(*) FILTER (WHERE NOT is_bot) AS not_bot,
          count(*) FILTER (WHERE NOT is_chore) AS not_chore, count(*) FILTER (WHERE subject_length <= 50) AS short_enough,
          count(*) FILTER (WHERE subject_word_count > 2) AS enough_words, count(*) FILTER (WHERE {cheap} AND {parsed_verb}) AS verb_object,
          count(*) FILTER (WHERE {cheap} AND {parsed_verb}) AS fitting
        FROM (SELECT *, {_words('subject')} AS w FROM flagged)"""
    )
    encoded = _sql(
        "SELECT sha, array_to_string(a, ' ') AS patch_ids, array_to_string(b, ' ') AS prompt_ids FROM encoded",
        _ENCODED,
    )
    out["encode"] = out["encode_by_join"] = encoded
    out["report_round_trip"] = out["bleu_report"]
    return out
