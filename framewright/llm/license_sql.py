"""The licence scan in DuckDB's SQL, for its oracle.

It shares the tables of sentences, rules and SPDX identifiers with the operator and none of
its code: sentences are normalised, names written out, expressions taken apart and rules
compared in SQL.
"""

from __future__ import annotations

from framewright.llm.license_scan import LEADS, NAMED, RULES, SENTENCES, SPDX


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


def _plain(x: str) -> str:
    return f"replace(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), 'licence', 'license')"


def duckdb_sql(documents: str = "documents") -> str:
    """doc_id, n_sentences, sentence_ids, licenses, n_licenses."""
    return rf"""
with raw(id, sentence) as (values {_values((i, x) for i, xs in SENTENCES.items() for x in xs)}),
name(id, name) as (values {_values((i, x) for i, xs in NAMED.items() for x in xs)}),
lead(lead) as (values {_values((x,) for x in LEADS)}),
known as (
  select distinct id, {_plain("sentence")} as sentence
  from (select id, sentence from raw union all select id, lead || ' ' || name || '.' from name, lead)
), spdx as (
  select lower(id) as word, 'spdx-' || lower(id) as id from (values {_values((x,) for x in SPDX)}) t(id)
  union all
  select lower(id) || '+', 'spdx-' || lower(id) || '-or-later' from (values {_values((x,) for x in SPDX)}) t(id) where id not like '%-only' and id not like '%-or-later'
), rule as (
  select row_number() over () as k, licence, ids, ' ' || replace(ids, ' ', ' .* ') || ' ' as pattern, ' ' || replace(ids, ' ', '  ') || ' ' as line
  from (values {_values((name, " ".join(ids)) for name, ids in RULES)}) t(licence, ids)
), bare as (
  select doc_id,
    regexp_replace(
      regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(^|\n)[ \t]*(?:[#*/;%!-]+|dnl\b|rem\b|REM\b|\.\.|'')[ \t]*', '\1', 'g'), '(?i)(spdx-license-identifier):[ \t\r\n]*', '\1 ', 'g'),
        '(?i)\b(v)\.[ \t\r\n]+([0-9])', '\1 \2', 'g'), '(?i)\b(inc|ltd|corp|co)\.[ \t\r\n]+(nor)\b', '\1 \2', 'g'),
      '(?i)(^|\n)([^\n]*spdx-license-identifier [^\n]*)', chr(10) || chr(10) || '\2' || chr(10), 'g') as text
  from {documents}
), cut as (
  select doc_id, way, string_split(regexp_replace(joined, '([.!?:;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) as parts
  from (select doc_id, 0 as way, regexp_replace(text, '([^.!?:;\n])\n([a-z(])', '\1 \2', 'g') as joined from bare
        union all select doc_id, 1, regexp_replace(text, '([^.!?:;\n])\n([^\n])', '\1 \2', 'g') from bare)
), each as (
  select doc_id, way, unnest(parts) as part, generate_subscripts(parts, 1) as pos from cut
), plain as (
  select doc_id, way, pos, part, regexp_replace(regexp_replace({_plain("part")}, '^neither the name of .* nor the names of its contributors ', 'neither the name of the copyright holder nor the names of its contributors '),
    ' see (the )?((license|copying|notice)( (md|txt|rst))? ){{1,2}}(file )?for (more |further )?(details|information)$', '') as sentence
  from each
), expression as (
  select doc_id, way, pos, string_split_regex(regexp_replace(lower(part), '(?s)^.*spdx-license-identifier\s*', ''), '[^a-z0-9.+-]+') as words
  from plain where sentence like 'spdx license identifier %' or sentence like '% spdx license identifier %'
), word as (
  select doc_id, way, pos, unnest(words) as word, generate_subscripts(words, 1) as place from expression
), ids as (
  select p.doc_id, p.way, p.pos, 0 as place, k.id from plain p join known k on p.sentence = k.sentence
  union all select w.doc_id, w.way, w.pos, w.place, s.id from word w join spdx s on rtrim(w.word, '.') = s.word
), way as (
  select doc_id, way, count(*) as n, string_agg(id, ',' order by pos, place) as ids, ' ' || string_agg(id, '  ' order by pos, place) || ' ' as line
  from ids group by doc_id, way qualify row_number() over (partition by doc_id order by n desc, way) = 1
), held as (
  select w.doc_id, r.* exclude (line) from way w join rule r on regexp_matches(w.line, r.pattern)
), told as (
  select doc_id, licence from held h where not exists (select 1 from held o join rule r on r.k = o.k where o.doc_id = h.doc_id and o.k <> h.k and regexp_matches(r.line, h.pattern))
  union
  select doc_id, substr(id, 6) || '-named' from (select doc_id, unnest(string_split(ids, ',')) as id from way) where id like 'spdx-%'
), licence as (
  select doc_id, string_agg(licence, ',' order by licence) as licenses, count(*) as n_licenses from told group by doc_id
)
select d.doc_id, coalesce(w.n, 0)::bigint as n_sentences, coalesce(w.ids, '') as sentence_ids, coalesce(l.licenses, '') as licenses, coalesce(l.n_licenses, 0)::bigint as n_licenses
from {documents} d left join way w on d.doc_id = w.doc_id left join licence l on d.doc_id = l.doc_id
"""
