"""Chunks and merged headings through the table functions, from SQL, with recursive SQL that keeps the same state along a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, tables
from ..sources import laws, pages
from .registry import _t, query


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


#: Texts with structural marks behind some sentences, alike in both engines.
_MARKED = "replace(replace(replace(text, '. D', '. Art. 5 D'), '. L', '. CAPÍTULO II Das coisas L'), '. E', '. § 3 E')"


def _sentence_sql(x: str) -> str:
    body = "CASE WHEN context IS NOT NULL THEN '[' || context || ']' || chr(10) || chr(10) || held ELSE held END"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_split_to_array({x}, '\.\s+') AS p FROM documents WHERE text <> ''),
w2 AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS j FROM w),
m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, {_strip("s")} || '.' AS s FROM w2 WHERE {_strip("s")} <> ''),
m2 AS (SELECT *, length(s) AS n, regexp_matches(s, '(?i)^(?:CAPÍTULO [IVXLCDM]+|SEÇÃO [IVXLCDM]+|Art\.\s*\d+|§\s*\d+|[IVXLCDM]+ -)') AS marker,
  contains(upper(s), 'CAPÍTULO') OR contains(upper(s), 'SEÇÃO') OR contains(upper(s), 'ART.') AS named, nullif(trim(regexp_extract(s, '(?i)^(?:CAPÍTULO|SEÇÃO|Art\.)\s+\S+(?:\s+\S+)?')), '') AS own FROM m),
r AS (
  SELECT doc_id, i, s AS held, n + 1 AS size, NULL::VARCHAR AS context, NULL::VARCHAR AS body, false AS flag FROM m2 WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN cut THEN s ELSE held || ' ' || s END, CASE WHEN cut THEN n ELSE size + n + 1 END, CASE WHEN cut AND marker AND named THEN own ELSE context END, CASE WHEN cut THEN {body} END, cut AND context IS NOT NULL
  FROM (SELECT r.doc_id, m2.i, r.held, r.size, r.context, m2.s, m2.n, m2.marker, m2.named, m2.own, r.size + m2.n > 1000 OR (m2.marker AND r.size > 100) AS cut FROM r JOIN m2 ON m2.doc_id = r.doc_id AND m2.i = r.i + 1)),
c AS (SELECT doc_id, i - 1 AS o, body, flag FROM r WHERE body IS NOT NULL
  UNION ALL SELECT doc_id, i, {body}, context IS NOT NULL FROM r WHERE i = (SELECT max(i) FROM m2 WHERE m2.doc_id = r.doc_id)),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k, count(*) OVER (PARTITION BY doc_id) AS n, body, flag FROM c),
j AS (SELECT *, false AS eaten FROM k WHERE k = 1
  UNION ALL SELECT k.*, NOT j.eaten AND length(j.body) < 100 AND length(j.body) + length(k.body) <= 1500 FROM j JOIN k ON k.doc_id = j.doc_id AND k.k = j.k + 1),
o AS (SELECT a.doc_id, a.k, CASE WHEN b.eaten THEN a.body || ' ' || b.body ELSE a.body END AS body, a.flag OR coalesce(b.eaten AND b.flag, false) AS flag, a.k = a.n AS at_end FROM j a LEFT JOIN j b ON b.doc_id = a.doc_id AND b.k = a.k + 1 WHERE NOT a.eaten),
t AS (SELECT *, at_end AND length(body) < 100 AND lag(length(body)) OVER v + length(body) <= 1500 AS tail FROM o WINDOW v AS (PARTITION BY doc_id ORDER BY k)),
u AS (SELECT *, lead(tail) OVER v AS takes, lead(body) OVER v AS rest, lead(flag) OVER v AS more FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, CASE WHEN takes THEN body || ' ' || rest ELSE body END AS content, flag OR coalesce(takes AND more, false) AS has_context FROM u WHERE NOT coalesce(tail, false))
"""


_F5_OUT = "SELECT doc_id, chunk_index, left(md5(doc_id || '_' || chunk_index), 16) AS chunk_id, length(content) AS size, md5(content) AS content_md5{more} FROM f"


def _sentence_rows(spark, sf, x: str, *more: str):
    docs = _t(spark, sf, "documents").select("doc_id", F.expr(x).alias("text"))
    rows = tables.register(spark).sql("SELECT d.doc_id, c.* FROM {docs} AS d, LATERAL chunk_sentences(d.text) AS c", docs=docs)
    return rows.select("doc_id", "chunk_index", chunking.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), F.length("content").cast("long").alias("size"), F.md5(F.col("content").cast("binary")).alias("content_md5"), *more)


@query(_sentence_sql("text") + _F5_OUT.format(more=""))
def f5_chunks(spark, sf):
    """Sentence chunks of whole texts by the table function."""
    return _sentence_rows(spark, sf, "text")


@query(_sentence_sql(_MARKED) + _F5_OUT.format(more=", has_context"))
def m4_marked_chunks(spark, sf):
    """Sentence chunks of texts with structural marks, which give chunks their context."""
    return _sentence_rows(spark, sf, _MARKED, "has_context")


def _markdown_sql(x: str) -> str:
    size = "coalesce(list_sum(list_transform({0}, lambda y: length(y))), 0)"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {x} AS x FROM documents WHERE text <> ''),
l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS pos FROM d),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^##+\s+.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM l),
s AS (SELECT doc_id, sec, coalesce(any_value({_strip("regexp_extract(line, '^##+\\s+(.+)', 1)")}) FILTER (WHERE regexp_matches(line, '^##+\s+.')), 'Introdução') AS title, {_strip("string_agg(line, chr(10) ORDER BY pos)")} AS content FROM g GROUP BY doc_id, sec),
s2 AS (SELECT * FROM s WHERE length(content) >= 100 UNION ALL SELECT doc_id, 0, 'Documento Completo', x FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE length(content) >= 100)),
p AS (SELECT doc_id, sec, unnest(string_split(content, chr(10) || chr(10))) AS p, unnest(range(len(string_split(content, chr(10) || chr(10))))) AS a FROM s2 WHERE length(content) > 1000),
p2 AS (SELECT doc_id, sec, a, {_strip("p")} AS p FROM p WHERE {_strip("p")} <> ''),
q AS (SELECT doc_id, sec, a, 0 AS b, 1 AS n, p AS t, 'p' AS kind FROM p2 WHERE length(p) <= 1000
  UNION ALL SELECT doc_id, sec, a, unnest(range(len(y))), len(y), unnest(y), 's' FROM (SELECT doc_id, sec, a, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS y FROM p2 WHERE length(p) > 1000)),
i AS (SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY a, b) AS i, count(*) OVER (PARTITION BY doc_id, sec) AS total, t, length(t) AS n, kind, b = 0 AS first, b = n - 1 AS last FROM q),
r AS (
  SELECT doc_id, sec, 0::BIGINT AS i, []::VARCHAR[] AS held, []::VARCHAR[] AS part, []::STRUCT(body VARCHAR, method VARCHAR)[] AS made FROM (SELECT DISTINCT doc_id, sec FROM i)
  UNION ALL
  SELECT doc_id, sec, i,
    CASE WHEN kind = 's' THEN CASE WHEN first THEN [] ELSE held END WHEN beyond THEN CASE WHEN length(held[-1]) <= 200 THEN held[-1:] ELSE [] END || [t] ELSE held || [t] END,
    CASE WHEN kind = 'p' OR last THEN [] ELSE next END,
    CASE WHEN kind = 'p' AND beyond THEN [{{'body': array_to_string(held, chr(10) || chr(10)), 'method': 'markdown_split_paragraph'}}]
         WHEN kind = 'p' THEN []
         ELSE CASE WHEN first AND len(held) > 0 THEN [{{'body': array_to_string(held, chr(10) || chr(10)), 'method': 'markdown_split_paragraph'}}] ELSE [] END
           || CASE WHEN filled THEN [{{'body': array_to_string(part, ' '), 'method': 'markdown_split_sentence_split'}}] ELSE [] END
           || CASE WHEN last THEN [{{'body': array_to_string(next, ' '), 'method': 'markdown_split_sentence_split'}}] ELSE [] END END
  FROM (SELECT *, CASE WHEN NOT filled THEN part WHEN len(part) > 1 AND length(array_to_string(part[-2:], ' ')) <= 200 THEN part[-2:] ELSE [] END || [t] AS next
        FROM (SELECT r.doc_id, r.sec, i.i, r.held, r.part, i.t, i.kind, i.first, i.last, len(r.held) > 0 AND {size.format("r.held")} + i.n > 1000 AS beyond, len(r.part) > 0 AND {size.format("r.part")} + i.n > 1000 AS filled
              FROM r JOIN i ON i.doc_id = r.doc_id AND i.sec = r.sec AND i.i = r.i + 1))),
e AS (SELECT doc_id, sec, i, unnest(range(len(made))) AS step, unnest(made) AS m FROM r
  UNION ALL SELECT doc_id, sec, i + 1, 0, {{'body': array_to_string(held, chr(10) || chr(10)), 'method': 'markdown_split_final'}} FROM r WHERE len(held) > 0 AND i = (SELECT max(total) FROM i WHERE i.doc_id = r.doc_id AND i.sec = r.sec)
  UNION ALL SELECT doc_id, sec, 0, 0, {{'body': content, 'method': 'markdown_section'}} FROM s2 WHERE length(content) <= 1000)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, i, step) - 1 AS INTEGER) AS chunk_index, m.method AS chunk_method, title AS section, md5(m.body) AS content_md5 FROM e JOIN s2 USING (doc_id, sec)
"""


def _markdown_rows(spark, sf, x: str):
    docs = _t(spark, sf, "documents").select("doc_id", F.expr(x).alias("text"))
    rows = tables.register(spark).sql("SELECT d.doc_id, c.* FROM {docs} AS d, LATERAL chunk_markdown(d.text) AS c", docs=docs)
    return rows.select("doc_id", "chunk_index", "chunk_method", "section", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(_markdown_sql("text"))
def f1_markdown_chunks(spark, sf):
    """Markdown chunks of whole texts by the table function."""
    return _markdown_rows(spark, sf, "text")


@query(_markdown_sql("regexp_replace(regexp_replace(text, '\\n([A-D])', chr(10) || '## Parte \\1', 'g'), '\\n([E-M])', chr(10) || chr(10) || '\\1', 'g')"))
def m4_headed_chunks(spark, sf):
    """Markdown chunks of texts with headings and paragraphs, sections of all sizes."""
    return _markdown_rows(spark, sf, "regexp_replace(regexp_replace(text, '\\\\n([A-D])', concat(char(10), '## Parte $1')), '\\\\n([E-M])', concat(char(10), char(10), '$1'))")


#: Lines of whole texts as sections: levels by place, sentences as paragraphs; alike in both engines.
_LEVEL = "1 + (doc_id + pos * pos) % 6"
_SECTION = "concat('S', pos)"


@query(rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text <> ''),
s AS (SELECT doc_id, pos, {_SECTION} AS title, {_LEVEL} AS level, replace(concat(line, '. ', line, ' ', line), '. ', '.' || chr(10) || chr(10)) AS content FROM l),
a AS (
  SELECT doc_id, -1::BIGINT AS pos, []::STRUCT(level BIGINT, title VARCHAR)[] AS above, ''::VARCHAR AS context FROM (SELECT DISTINCT doc_id FROM s)
  UNION ALL
  SELECT doc_id, pos, CASE WHEN level <= 3 THEN open || [{{'level': level, 'title': title}}] ELSE open END, array_to_string(list_transform(open, lambda y: y.title), ' > ')
  FROM (SELECT s.doc_id, s.pos, s.level, s.title, list_filter(a.above, lambda y: y.level < s.level) AS open FROM a JOIN s ON s.doc_id = a.doc_id AND s.pos = a.pos + 1)),
c AS (SELECT s.*, CASE WHEN context <> '' THEN context || chr(10) || chr(10) ELSE '' END AS context FROM s JOIN a USING (doc_id, pos)),
p AS (SELECT doc_id, pos, context, unnest(string_split(content, chr(10) || chr(10))) AS p, unnest(range(len(string_split(content, chr(10) || chr(10))))) AS j FROM c WHERE length(content) + length(context) > 1000),
i AS (SELECT doc_id, pos, context, row_number() OVER (PARTITION BY doc_id, pos ORDER BY j) AS i, count(*) OVER (PARTITION BY doc_id, pos) AS total, {_strip("p")} AS p FROM p WHERE {_strip("p")} <> ''),
r AS (
  SELECT doc_id, pos, 0::BIGINT AS i, NULL::VARCHAR AS held, length(context) AS size, 0 AS part, NULL::VARCHAR AS body FROM i WHERE i = 1
  UNION ALL
  SELECT doc_id, pos, i, CASE WHEN cut OR held IS NULL THEN p ELSE held || '  ' || p END, CASE WHEN cut THEN length(context) + length(p) ELSE size + length(p) + 2 END,
    CASE WHEN cut AND held IS NOT NULL THEN part + 1 ELSE part END, CASE WHEN cut AND held IS NOT NULL THEN context || held END
  FROM (SELECT r.doc_id, r.pos, i.i, r.held, r.size, r.part, i.p, i.context, r.size + length(i.p) + 2 > 1000 AS cut FROM r JOIN i ON i.doc_id = r.doc_id AND i.pos = r.pos AND i.i = r.i + 1)),
e AS (SELECT doc_id, pos, i AS step, part, body FROM r WHERE body IS NOT NULL
  UNION ALL SELECT r.doc_id, r.pos, r.i + 1, r.part + 1, i.context || chr(10) || chr(10) || r.held FROM r JOIN i ON i.doc_id = r.doc_id AND i.pos = r.pos AND i.i = r.i AND i.i = i.total
  UNION ALL SELECT doc_id, pos, 0, NULL, context || content FROM c WHERE length(content) + length(context) <= 1000)
SELECT e.doc_id, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY e.pos, step) - 1 AS INTEGER) AS n, c.title AS section_title, c.context <> '' AS has_context, CAST(coalesce(part, 0) AS INTEGER) AS part_number, md5({_strip("body")}) AS content_md5
FROM e JOIN c USING (doc_id, pos)
""")
def f3_line_sections(spark, sf):
    """Chunks of sections by the partitioned table function: each line of a text is a section, its sentences are paragraphs."""
    lines = _t(spark, sf, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    content = F.expr("replace(concat(line, '. ', line, ' ', line), '. ', concat('.', char(10), char(10)))")
    rows = lines.select("doc_id", F.col("pos").alias("position"), F.expr(_SECTION).alias("title"), F.expr(f"cast({_LEVEL} as int)").alias("level"), content.alias("content"))
    out = tables.register(spark).sql("SELECT * FROM chunk_sections(TABLE({rows}), id => 'doc_id')", rows=rows)
    return out.select("doc_id", "n", "section_title", "has_context", F.coalesce("part_number", F.lit(0)).alias("part_number"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


#: Headings by place over the lines of whole texts: numbered ones without content, their texts, and lines; alike in both engines.
_HEADING = "CASE (doc_id + pos * 7 + pos * pos) % 11 WHEN 0 THEN 'ANEXO' WHEN 1 THEN 'REGULAMENTO' WHEN 2 THEN 'LIVRO II' WHEN 3 THEN 'DAS COISAS' WHEN 4 THEN 'CAPÍTULO IV' WHEN 5 THEN 'Seção Única' WHEN 6 THEN 'SUBSEÇÃO ÚNICA' WHEN 7 THEN 'DOS ATOS' WHEN 8 THEN 'Art. 5' WHEN 9 THEN '' ELSE line END"
_CONTENT = "CASE WHEN (doc_id + pos) % 3 = 0 THEN line ELSE '' END"


@query(rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text <> ''),
s AS (SELECT doc_id, pos, {_HEADING} AS title, CAST({_LEVEL} AS INTEGER) AS level, {_CONTENT} AS content FROM l),
r AS (
  SELECT doc_id, pos, title, level, content, 0 AS taken, pos AS top FROM s WHERE pos = 0
  UNION ALL
  SELECT doc_id, pos, CASE WHEN takes THEN title || CASE WHEN joined THEN chr(10) ELSE ' - ' END || next ELSE next END, CASE WHEN takes THEN level ELSE next_level END, next_content, CASE WHEN takes THEN taken + 1 ELSE 0 END, CASE WHEN takes THEN top ELSE pos END
  FROM (SELECT *, title <> '' AND {_strip("content")} = '' AND b <> '' AND ((a = 'ANEXO' AND contains(b, 'REGULAMENTO')) OR ({_strip("next_content")} = ''
          AND CASE WHEN joined OR regexp_matches(a, '^(LIVRO|TÍTULO)\s+[IVXLCDM]+(-[A-Z]+)?$') THEN regexp_matches(b, '^(DA|DO|DAS|DOS)\s')
              ELSE regexp_matches(a, '^(CAPÍTULO\s+[IVXLCDM0-9]+(-[A-Z]+)?|SE[ÇC][ÃA]O\s+[IVXLCDM0-9]+(-[A-Z]+)?|SUBSE[ÇC][ÃA]O\s+(ÚNICA|[IVXLCDM0-9]+(-[A-Z]+)?))$') AND NOT starts_with(b, 'ART.') END)) AS takes
        FROM (SELECT r.doc_id, s.pos, r.title, r.level, r.content, r.taken, r.top, s.title AS next, s.level AS next_level, s.content AS next_content, r.taken > 0 OR contains(r.title, ' - ') AS joined, upper({_strip("r.title")}) AS a, upper({_strip("s.title")}) AS b
              FROM r JOIN s ON s.doc_id = r.doc_id AND s.pos = r.pos + 1))),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, top ORDER BY pos DESC) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY top) - 1 AS INTEGER) AS position, md5(title) AS title_md5, level, md5(content) AS content_md5 FROM f
""")
def e8_line_headings(spark, sf):
    """Merged headings by the partitioned table function, each line of a text being a heading or a text."""
    lines = _t(spark, sf, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = lines.select("doc_id", F.col("pos").alias("position"), F.expr(_HEADING).alias("title"), F.expr(f"cast({_LEVEL} as int)").alias("level"), F.expr(_CONTENT).alias("content"))
    out = tables.register(spark).sql("SELECT * FROM merge_headings(TABLE({rows}), id => 'doc_id')", rows=rows)
    return out.select("doc_id", "position", F.md5(F.col("title").cast("binary")).alias("title_md5"), "level", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query()
def f3_section_chunks(spark, sf):
    """Chunks of the sections of web pages by the partitioned table function."""
    rows = pages.pages_to_sections(_t(spark, sf, "pages"))
    return tables.register(spark).sql("SELECT * FROM chunk_sections(TABLE({rows}), id => 'page_id')", rows=rows)


@query()
def e8_merged_headings(spark, sf):
    """Merged headings of styled pages by the partitioned table function."""
    rows = laws.styled_sections(_t(spark, sf, "pages"))
    return tables.register(spark).sql("SELECT * FROM merge_headings(TABLE({rows}), id => 'page_id')", rows=rows)
