"""DuckDB SQL for the registered queries, written from what they mean, not from how Spark plans them."""

from __future__ import annotations

from larkspur.operators.attribution import MESSAGES, REPAIR_HEAD, REPAIR_TAIL
from larkspur.plans.queries import DIM

ORACLES: dict[str, str] = {}

DOCS = "docs AS (SELECT doc_id AS doc_ord, doc_id::VARCHAR AS doc_id, trim(split_part(text, chr(10), 1)) AS title, text, source, 'unknown' AS license FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS qid, text AS query FROM benchmark)"
DOC_CHUNKS = f"{DOCS}, chunks AS (SELECT doc_ord AS chunk_ord, title, text FROM docs)"


def terms(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda t: NOT regexp_full_match(t, '[a-z0-9]'))"


def windows(size: int, overlap: int, name: str = "chunks") -> str:
    """Fixed windows of docs; the first blank one and all after it are left out."""
    stride = size - overlap
    return f"""{name}_all AS (SELECT doc_ord, doc_id, title, text AS doc_text, i AS n, i * {stride} AS start, least(i * {stride} + {size}, length(text)) AS "end"
  FROM docs, range(0, 1 + greatest(ceil((length(text) - {size}) / {stride}.0)::BIGINT, 0)) r(i) WHERE length(text) > 0),
{name}_text AS (SELECT *, substr(doc_text, start + 1, "end" - start) AS text FROM {name}_all),
{name} AS (SELECT doc_ord * 1048576 + n AS chunk_ord, doc_ord, doc_id || '#' || n AS chunk_id, doc_id, n, title, start::BIGINT AS start, "end"::BIGINT AS "end", text FROM (
  SELECT *, min(CASE WHEN regexp_full_match(text, '\\s*') THEN n END) OVER (PARTITION BY doc_ord) AS blank FROM {name}_text) WHERE blank IS NULL OR n < blank)""".replace("\\\\", "\\")


def folded(name: str, items: str, most: int) -> str:
    """Items (doc_ord, i from 1, a, b, mode) one after another into spans of one document: an item begins a span ('new'), or joins the last one if the whole stays within most ('whole'), or their lengths do ('sum')."""
    joins = f"CASE mode WHEN 'whole' THEN t.b - r.s <= {most} WHEN 'sum' THEN r.e - r.s + t.b - t.a <= {most} ELSE false END"
    return f"""{name}_fold AS (SELECT doc_ord, i, a AS s, b AS e, 0::BIGINT AS n FROM {items} WHERE i = 1
  UNION ALL SELECT r.doc_ord, t.i, CASE WHEN {joins} THEN r.s ELSE t.a END, t.b, r.n + CASE WHEN {joins} THEN 0 ELSE 1 END FROM {name}_fold r JOIN {items} t ON t.doc_ord = r.doc_ord AND t.i = r.i + 1),
{name}_spans AS (SELECT doc_ord, n, min(s)::BIGINT AS start, max(e)::BIGINT AS "end" FROM {name}_fold GROUP BY ALL)"""


SENTENCE = r"[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+$"


def sentences(name: str, blocks: str) -> str:
    """(doc_ord, a, b, nth) of the sentences that aren't blank, of blocks (doc_ord, a, part), nth counting them in their block."""
    return rf"""{name}_parts AS (SELECT doc_ord, a AS block, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM (SELECT doc_ord, a, regexp_extract_all(part, '{SENTENCE}') AS l FROM {blocks})),
{name}_placed AS (SELECT *, block + sum(length(s)) OVER (PARTITION BY doc_ord, block ORDER BY k) AS b FROM {name}_parts),
{name} AS (SELECT doc_ord, b - length(s) AS a, b, row_number() OVER (PARTITION BY doc_ord, block ORDER BY k) AS nth FROM {name}_placed WHERE NOT regexp_full_match(s, '\s*'))"""


def structure(name: str, most: int) -> str:
    """Spans of docs that begin at headings and blank lines: small neighbours joined by length, large ones packed by sentence."""
    return rf"""{name}_lines AS (SELECT doc_ord, text, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_ord, text, string_split(text, chr(10)) AS l FROM docs)),
{name}_at AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_ord ORDER BY k) - length(line) - 1)::BIGINT AS a FROM {name}_lines),
{name}_begins AS (SELECT doc_ord, text, a, lead(a, 1, length(text)) OVER (PARTITION BY doc_ord ORDER BY a) AS b FROM {name}_at WHERE k = 1 OR regexp_matches(line, '^#{{1,6}}\s') OR regexp_full_match(line, '\s*')),
{name}_blocks AS (SELECT doc_ord, a, b, substr(text, a + 1, b - a) AS part FROM {name}_begins WHERE NOT regexp_full_match(substr(text, a + 1, b - a), '\s*')),
{name}_large AS (SELECT * FROM {name}_blocks WHERE b - a > {most}), {sentences(f"{name}_s", f"{name}_large")},
{name}_items AS (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY a) AS i FROM (
  SELECT doc_ord, a, b, 'sum' AS mode FROM {name}_blocks WHERE b - a <= {most} UNION ALL SELECT doc_ord, a, b, CASE WHEN nth = 1 THEN 'new' ELSE 'whole' END FROM {name}_s)),
{folded(name, f"{name}_items", most)}"""


def children(name: str, child: int, parent: int) -> str:
    """Sentences packed within spans of structure."""
    return f"""{structure(f"{name}_p", parent)}, {name}_in AS (SELECT doc_ord, start AS a, substr(text, start + 1, "end" - start) AS part FROM {name}_p_spans JOIN docs USING (doc_ord)), {sentences(f"{name}_c", f"{name}_in")},
{name}_items AS (SELECT doc_ord, a, b, CASE WHEN nth = 1 THEN 'new' ELSE 'whole' END AS mode, row_number() OVER (PARTITION BY doc_ord ORDER BY a) AS i FROM {name}_c),
{folded(name, f"{name}_items", child)}"""


#: Documents with headings, blank lines and full stops of both kinds planted, as in the queries.
STRUCTURED = DOCS.replace(" text, source", " CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(10) || chr(10) || '## ') WHEN 2 THEN replace(text, '. ', '。') ELSE replace(replace(text, ' a', chr(10) || ' ' || chr(10) || 'a'), '. ', '！？ ') END AS text, source")


def bm25(chunks: str = "chunks", questions: str = "questions") -> str:
    return f"""toks AS (SELECT chunk_ord, unnest({terms("title || ' ' || text")}) AS term FROM {chunks}),
tf AS (SELECT chunk_ord, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT chunk_ord, len({terms("title || ' ' || text")}) AS len FROM {chunks}),
stats AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, term, min(pos) AS pos FROM (SELECT qid, unnest({terms("query")}) AS term, generate_subscripts({terms("query")}, 1) AS pos FROM {questions}) GROUP BY ALL),
scored AS (SELECT qid, chunk_ord, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / avgdl))), 6) AS score, string_agg(term, ' ' ORDER BY pos) AS matched
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_ord), stats GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ord) AS rank FROM scored)"""


def fake(source: str, key: str, text: str, name: str) -> str:
    """Counts of characters by code modulo DIM, of unit length, as floats."""
    return f"""{name} AS (SELECT {key}, list(v ORDER BY d) AS embedding FROM (
  SELECT x.{key}, r.d, (coalesce(c, 0) / (CASE WHEN n = 0 THEN 1 ELSE sqrt(n) END))::FLOAT AS v FROM (SELECT {key}, unnest(range({DIM})) AS d FROM {source}) r
  JOIN (SELECT {key} FROM {source}) x USING ({key}) LEFT JOIN {name}_counts k ON k.{key} = x.{key} AND k.d = r.d
  LEFT JOIN (SELECT {key}, sum(c * c) AS n FROM {name}_counts GROUP BY 1) s ON s.{key} = x.{key}) GROUP BY 1)""", f"{name}_counts AS (SELECT {key}, unicode(ch) % {DIM} AS d, count(*)::DOUBLE AS c FROM (SELECT {key}, unnest(string_split({text}, '')) AS ch FROM {source}) WHERE ch <> '' GROUP BY ALL)"


def sem() -> str:
    dv, dc = fake("docs", "doc_ord", "text", "dv")
    qv, qc = fake("questions", "qid", "query", "qv")
    return f"""{dc}, {dv}, {qc}, {qv},
sem AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ord) AS rank FROM (
  SELECT qid, doc_ord AS chunk_ord, round(list_inner_product(qv.embedding::DOUBLE[], dv.embedding::DOUBLE[]), 6) AS score FROM qv, dv))"""


def fused(size: int, name: str = "pool") -> str:
    return f"""{name}_lists AS (SELECT qid, 'bm25' AS route, chunk_ord, rank FROM lex WHERE rank <= {size} UNION ALL SELECT qid, 'vector', chunk_ord, rank FROM sem WHERE rank <= {size}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ord) AS rank FROM (
  SELECT qid, chunk_ord, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(CASE WHEN route = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN route = 'vector' THEN rank END) AS vector_rank FROM {name}_lists GROUP BY ALL)) WHERE rank <= {size})"""


GOLD = "gold_pairs AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
EDGES = """mention AS (SELECT a.doc_ord AS holder, b.doc_ord AS owner FROM docs a JOIN docs b ON a.doc_ord <> b.doc_ord AND length(b.title) >= 2 AND contains(a.text, b.title)),
edges AS (SELECT src, dst, min(phase) AS phase FROM (SELECT holder AS src, owner AS dst, CASE WHEN owner < holder THEN 0 ELSE 2 END AS phase FROM mention
  UNION ALL SELECT owner, holder, 1 FROM mention) GROUP BY ALL)"""
OVERLAP = r"(SELECT count(DISTINCT ch)::DOUBLE FROM unnest(string_split({q}, '')) u(ch) WHERE ch <> '' AND NOT regexp_full_match(ch, '\s') AND contains({t}, ch))"


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


sql("load_docs", f"WITH {DOCS} SELECT doc_ord, doc_id, title, length(text) AS n_chars, source, license FROM docs")
sql("parse_front_matter", f"WITH {DOCS} SELECT doc_ord, CASE WHEN doc_ord % 3 = 0 THEN doc_id ELSE 'Doc: ' || doc_id END AS title, md5(CASE WHEN doc_ord % 3 = 0 THEN text ELSE regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') END) AS text_md5, CASE WHEN doc_ord % 3 = 0 THEN 'unknown' ELSE source END AS source, 'unknown' AS license FROM docs")
sql("strip_tail", r"SELECT doc_id AS doc_ord, md5(regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || chr(10) || '参考文献 later' END, '^\s+', ''), '\s+$', '')) AS text_md5 FROM documents")
sql("slug", rf"""WITH {DOCS} SELECT doc_ord, 'wiki-' || CASE WHEN doc_ord < 1000 THEN lpad(doc_ord::VARCHAR, 3, '0') ELSE doc_ord::VARCHAR END || '-' || regexp_replace(title, '[/\\:*?"<>|\s]', '_', 'g') AS slug FROM docs""")
sql("ingest_filter", r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 5 <> 4 THEN html END AS raw FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)),
t AS (SELECT raw, length(regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '')) AS n FROM p)
SELECT count(*) FILTER (WHERE n >= 2000) AS n_ok, count(*) FILTER (WHERE n IS NULL OR n < 2000) AS n_miss, coalesce(sum(n) FILTER (WHERE n >= 2000), 0)::BIGINT AS n_chars FROM t""")
sql("embed_todo", "SELECT vec_id AS chunk_ord FROM embeddings WHERE NOT (vec_id % 3 <> 2 AND vec_id % 2 = 0)")
sql("memo_runs", f"""WITH {DOCS}, {", ".join(reversed(fake("docs", "doc_ord", "text", "dv")))}
SELECT doc_ord, min(CASE WHEN doc_ord % 3 = 0 THEN 1 WHEN doc_ord % 2 = 0 THEN 2 ELSE 3 END) OVER (PARTITION BY text) AS run, length(text) AS n_chars, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM docs JOIN dv USING (doc_ord)""")
sql("cache_compact", "SELECT vec_id AS chunk_ord FROM embeddings WHERE vec_id % 3 <> 2 AND vec_id % 2 = 0")
sql("vector_coverage", "SELECT count(*) AS n_chunks, count(*) FILTER (WHERE vec_id % 3 <> 2 AND vec_id % 2 = 0) AS n_vectors FROM embeddings")
sql("vector_roundtrip", "SELECT vec_id, true AS same, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
sql("sentence_spans", rf"""WITH {DOCS}, parts AS (SELECT doc_ord, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_ord, regexp_extract_all(text, '[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+$') AS l FROM docs)),
placed AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_ord ORDER BY i) AS e FROM parts)
SELECT doc_ord, row_number() OVER (PARTITION BY doc_ord ORDER BY i) - 1 AS n, (e - length(s))::BIGINT AS start, e::BIGINT AS "end" FROM placed WHERE NOT regexp_full_match(s, '\s*')""")
for name, overlap in (("chunk_fixed", 0), ("chunk_overlap", 60)):
    sql(name, f'WITH {DOCS}, {windows(300, overlap)} SELECT chunk_ord, chunk_id, start, "end", md5(text) AS text_md5 FROM chunks')
SPANS = """c.doc_ord * 1048576 + n AS chunk_ord, doc_id || '#' || n AS chunk_id, c.start, c."end", md5(substr(text, c.start + 1, c."end" - c.start)) AS text_md5"""
sql("structure_chunks", f"WITH RECURSIVE {STRUCTURED}, {structure('u', 300)} SELECT {SPANS} FROM u_spans c JOIN docs USING (doc_ord)")
sql("parent_child", f"""WITH RECURSIVE {STRUCTURED}, {children('v', 120, 400)}, p AS (SELECT doc_ord AS p_ord, start AS p_start, "end" AS p_end FROM v_p_spans)
SELECT {SPANS}, md5(substr(text, p_start + 1, p_end - p_start)) AS context_md5 FROM v_spans c JOIN docs USING (doc_ord) JOIN p ON p_ord = c.doc_ord AND c.start BETWEEN p_start AND p_end - 1""")
STRATEGIES = {"fixed": windows(300, 0, "k_fixed"), "overlap": windows(300, 60, "k_overlap"), "structure": structure("k_structure", 300), "parent-child": children("k_child", 120, 400)}
CHUNKS_OF = {"fixed": "k_fixed", "overlap": "k_overlap", "structure": "k_structure_spans", "parent-child": "k_child_spans"}
sql("chunk_strategies", f"WITH RECURSIVE {DOCS}, {', '.join(STRATEGIES.values())} " + " UNION ALL ".join([f"""SELECT '{k}' AS strategy, count(*) AS n_chunks, sum("end" - start)::BIGINT AS n_chars FROM {v}""" for k, v in CHUNKS_OF.items()]))
sql("chunk_stats", f"""WITH {DOCS}, {windows(300, 60)}, l AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS i, count(*) OVER () AS n FROM chunks)
SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT sum(length(text)) FROM docs)::BIGINT AS n_chars, any_value(n) AS n_chunks, min(len) AS min_len, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN len END) AS p50_len,
max(CASE WHEN i = least(n - 1, floor(n * 0.9)) THEN len END) AS p90_len, max(len) AS max_len FROM l""")
sql("chunk_invariant", "SELECT unnest(['fixed', 'overlap', 'structure', 'parent-child']) AS strategy, (SELECT count(*) FROM documents) = 0 AS empty, 0::BIGINT AS n_faults")
sql("chunk_coverage", f"""WITH {DOCS}, {windows(300, 0)}, {windows(300, 60, "lapped")} SELECT 0::INT AS overlap, count(*) AS n_chunks, sum("end" - start)::BIGINT AS n_chars, 0::BIGINT AS n_holes FROM chunks
UNION ALL SELECT 60, count(*), sum("end" - start)::BIGINT, 0 FROM lapped""")
sql("han_terms", f"WITH {DOCS} SELECT doc_ord, array_to_string(list_concat(['玄武岩', '喷出岩'], {terms('title')}), ' ') AS terms FROM docs")
sql("term_freq", f"WITH {DOC_CHUNKS}, {bm25('chunks', '(SELECT 1 AS qid, NULL::VARCHAR AS query)')} SELECT chunk_ord, term, tf FROM tf")
sql("corpus_stats", f"WITH {DOC_CHUNKS}, {QUESTIONS}, {bm25()} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms FROM stats")
sql("idf", f"WITH {DOC_CHUNKS}, {QUESTIONS}, {bm25()} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, stats")
sql("bm25_index", f"WITH {DOC_CHUNKS}, {QUESTIONS}, {bm25()} SELECT chunk_ord, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, sum(df)::BIGINT AS sum_df FROM tf JOIN df USING (term) GROUP BY 1")
sql("han_segments", r"""WITH w AS (SELECT doc_id AS doc_ord, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '') AS words FROM documents)
SELECT doc_ord, len(words) AS n_true, md5(array_to_string(list_transform(words, lambda x: array_to_string(list_transform(range(1 + ('0x' || substr(md5(x), 21, 2))::INT % 3), lambda i: chr((28416 + ('0x' || substr(md5(x), 1 + 4 * i::INT, 4))::INT % 300)::INT)), '')), '')) AS text_md5 FROM w""")
sql("han_boundaries", r"SELECT sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')))::BIGINT AS n_true, true AS reached FROM documents")
sql("bm25_topk", f"WITH {DOCS}, {windows(300, 0)}, {QUESTIONS}, {bm25()} SELECT qid, chunk_ord, score, rank FROM lex WHERE rank <= 5")
sql("stored_topk", ORACLES["bm25_topk"])
sql("stored_share", f"WITH {DOCS}, {windows(300, 0)}, {QUESTIONS}, {bm25()} SELECT qid, sum(df)::BIGINT AS n_postings, true AS within FROM qt JOIN df USING (term) GROUP BY qid")
sql("bm25_matched", f"WITH {DOC_CHUNKS}, {QUESTIONS}, {bm25()} SELECT qid, chunk_ord, rank, matched FROM lex WHERE rank <= 5")
sql("l2_normalized", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS l1 FROM embeddings")
VECTOR_PAIRS = "SELECT q.vec_id AS qid, v.vec_id AS chunk_ord, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0"
sql("vector_topk", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ord) AS rank FROM ({VECTOR_PAIRS})) WHERE rank <= 10")
sql("ann_stored", "SELECT vec_id AS qid, least(10, (SELECT count(*) FROM embeddings)) AS n_hits, least(10, (SELECT count(*) FROM embeddings)) AS n_same FROM embeddings WHERE vec_id % 20 = 0")
sql("ann_graph_recall", "SELECT 10 * count(*) AS n_true, true AS reached, count(*) AS n_self FROM embeddings WHERE vec_id % 20 = 0")
sql("ann_first", "SELECT vec_id AS qid, least(10, (SELECT count(*) FROM embeddings)) AS n_hits, vec_id AS first, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS score FROM embeddings WHERE vec_id % 20 = 0")
sql("ann_recall", "SELECT unnest(['table', 'copies']) AS vectors, (SELECT 10 * count(*) FROM embeddings WHERE vec_id % 20 = 0) AS n_true, true AS reached")
U32 = "4294967295::HUGEINT"
sql("seeded_random", f"""WITH a AS (SELECT vec_id, (7 + (vec_id + 1) * 1831565813::HUGEINT) & {U32} AS a FROM embeddings),
t AS (SELECT vec_id, (xor(a, a >> 15) * (a | 1)) & {U32} AS t FROM a), u AS (SELECT vec_id, xor((t + xor(t, t >> 7) * (t | 61)) & {U32}, t) AS u FROM t)
SELECT vec_id, round(xor(u, u >> 14)::DOUBLE / 4294967296, 9) AS value FROM u""")
BASE = f"{DOC_CHUNKS}, {QUESTIONS}, {bm25()}"
BOTH = f"{BASE}, {sem()}"
sql("fake_embedding", f"WITH {BASE}, {sem()} SELECT doc_ord AS chunk_ord, round(embedding[1]::DOUBLE, 4) AS v0, round(embedding[2]::DOUBLE, 4) AS v1, round(embedding[{DIM}]::DOUBLE, 4) AS v{DIM - 1} FROM dv")
sql("fake_vector_topk", f"WITH {BOTH} SELECT qid, chunk_ord, round(score, 4) AS score, rank FROM sem WHERE rank <= 5")
sql("rrf_fuse", f"WITH {BOTH}, {fused(20)} SELECT qid, chunk_ord, rank, score, bm25_rank, vector_rank FROM pool")
sql("hybrid_topk", f"WITH {BOTH}, {fused(50)} SELECT qid, chunk_ord, rank FROM pool WHERE rank <= 10")
sql("hybrid_guarantee", f"""WITH {BOTH}, {fused(10)},
wanted AS (SELECT qid, chunk_ord, min(o) AS o FROM (SELECT qid, chunk_ord, rank AS o FROM lex WHERE rank <= 5 UNION ALL SELECT qid, chunk_ord, 100 + rank FROM sem WHERE rank <= 5) GROUP BY ALL),
missing AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS r, count(*) OVER (PARTITION BY qid) AS extra FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.qid = w.qid AND p.chunk_ord = w.chunk_ord)),
joined AS (SELECT p.qid, p.chunk_ord, p.rank AS o FROM pool p LEFT JOIN (SELECT DISTINCT qid, extra FROM missing) m USING (qid) WHERE p.rank <= 10 - coalesce(m.extra, 0) UNION ALL SELECT qid, chunk_ord, 100 + r FROM missing)
SELECT qid, chunk_ord, row_number() OVER (PARTITION BY qid ORDER BY o) AS rank FROM joined""")
sql("multi_query", f"""WITH {DOC_CHUNKS}, variants AS (SELECT item_id AS qid0, 0 AS variant, text AS query FROM benchmark UNION ALL SELECT b.item_id - 1, 1, b.text FROM benchmark b WHERE b.item_id - 1 IN (SELECT item_id FROM benchmark)),
questions AS (SELECT qid0 * 2 + variant AS qid, query FROM variants), {bm25()},
lists AS (SELECT qid // 2 AS q, chunk_ord, rank, (SELECT count(*) FROM variants v WHERE v.qid0 = lex.qid // 2) AS n FROM lex WHERE rank <= 20),
fused AS (SELECT q AS qid, chunk_ord, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_ord) AS rank FROM (SELECT q, chunk_ord, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists WHERE n > 1 GROUP BY ALL))
SELECT * FROM (SELECT q AS qid, chunk_ord, rank FROM lists WHERE n = 1 UNION ALL SELECT * FROM fused) WHERE rank <= 10""")
_overlap = OVERLAP.format(q="q.query", t="c.text")
sql("rerank_overlap", f"""WITH {BASE}, r AS (SELECT p.qid, p.chunk_ord, p.rank AS before, {_overlap} AS score FROM lex p JOIN questions q USING (qid) JOIN chunks c USING (chunk_ord) WHERE p.rank <= 20)
SELECT * FROM (SELECT qid, chunk_ord, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank, score FROM r) WHERE rank <= 5""")
sql("rerank_lift", f"""WITH {BASE}, r AS (SELECT p.qid, p.chunk_ord, p.rank AS before, {_overlap} AS score FROM lex p JOIN questions q USING (qid) JOIN chunks c USING (chunk_ord) WHERE p.rank <= 10)
SELECT qid, chunk_ord, rank, before, before - rank AS lift FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM r)""")
sql("graph_edges", f"WITH {DOCS}, {EDGES} SELECT src, dst, phase::BIGINT AS phase FROM edges")
sql("graph_stats", f"""WITH {DOCS}, {EDGES}, degree AS (SELECT d.doc_ord, count(e.src) AS d FROM docs d LEFT JOIN edges e ON e.src = d.doc_ord GROUP BY 1)
SELECT count(*) AS nodes, (sum(d) // 2)::BIGINT AS edges, count(*) FILTER (WHERE d = 0) AS n_isolated, (SELECT string_agg(doc_ord || ':' || d, ',' ORDER BY d DESC, doc_ord) FROM (SELECT * FROM degree WHERE d > 0 ORDER BY d DESC, doc_ord LIMIT 5)) AS top_hubs FROM degree""")
sql("graph_two_hops", f"WITH {DOCS}, {EDGES} SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE b.dst <> a.src")
sql("graph_expand", f"""WITH {BASE}, {EDGES}, pool AS (SELECT qid, chunk_ord, rank FROM lex WHERE rank <= 10),
near AS (SELECT qid, dst, min(p.rank * 10000000000 + e.phase * 1000000000 + e.dst) AS o FROM pool p JOIN edges e ON e.src = p.chunk_ord WHERE p.rank <= 3 GROUP BY ALL),
added AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS r FROM near n WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.qid = n.qid AND p.chunk_ord = n.dst)) WHERE r <= 5),
sizes AS (SELECT qid, count(*) AS size FROM pool GROUP BY 1), extra AS (SELECT qid, count(*) AS extra FROM added GROUP BY 1),
joined AS (SELECT p.qid, p.chunk_ord, p.rank AS o FROM pool p JOIN sizes USING (qid) LEFT JOIN extra USING (qid) WHERE p.rank <= greatest(0, size - coalesce(extra, 0)) UNION ALL SELECT qid, dst, 100 + r FROM added)
SELECT qid, chunk_ord, row_number() OVER (PARTITION BY qid ORDER BY o) AS rank FROM joined""")
sql("doc_ranking", f"""WITH {DOCS}, {windows(300, 0)}, {QUESTIONS}, {bm25()}, f AS (SELECT qid, chunk_ord // 1048576 AS doc_id, min(rank) AS r FROM lex WHERE rank <= 20 GROUP BY ALL)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM f""")
OUTCOMES = f"""{BASE}, {GOLD}, outcomes AS (SELECT q.qid, coalesce((SELECT min(rank) - 1 FROM lex JOIN gold_pairs g ON g.qid = lex.qid AND g.doc_id = lex.chunk_ord WHERE lex.qid = q.qid AND rank <= 10), -1) AS rank,
coalesce((SELECT min(rank) - 1 FROM lex JOIN gold_pairs g ON g.qid = lex.qid AND g.doc_id = lex.chunk_ord WHERE lex.qid = q.qid AND rank <= 20), -1) AS pool_rank FROM questions q),
s AS (SELECT * FROM outcomes WHERE qid IN (SELECT qid FROM gold_pairs)),
summary AS (SELECT count(*) AS n, {', '.join(f"round(coalesce(avg((rank >= 0 AND rank < {k})::INT), 0), 6) AS recall_{k}" for k in (1, 3, 5, 10))}, round(coalesce(avg(CASE WHEN rank >= 0 AND rank < 10 THEN 1.0::DOUBLE / (rank + 1) ELSE 0 END), 0), 6) AS mrr, round(coalesce(avg((pool_rank >= 0)::INT), 0), 6) AS pool_recall FROM s)"""
WHOLE = {"fixed": "SELECT chunk_ord, title, text FROM k_fixed", "overlap": "SELECT chunk_ord, title, text FROM k_overlap"} | {
    k: f"""SELECT c.doc_ord * 1048576 + n AS chunk_ord, title, substr(text, c.start + 1, c."end" - c.start) AS text FROM {CHUNKS_OF[k]} c JOIN docs USING (doc_ord)""" for k in ("structure", "parent-child")}
SWEEP = """SELECT * FROM (WITH chunks AS ({chunks}), {bm25}, f AS (SELECT qid, chunk_ord // 1048576 AS doc_id, min(rank) AS r FROM lex WHERE rank <= 10 GROUP BY ALL),
ranked AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY r) - 1 AS rank FROM f), best AS (SELECT qid, min(rank) AS rank FROM gold_pairs LEFT JOIN ranked USING (qid, doc_id) GROUP BY qid)
SELECT '{name}' AS strategy, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT round(avg(length(text)), 4) FROM chunks) AS avg_len, round(coalesce(avg((coalesce(rank, 99) < 1)::INT), 0), 6) AS recall_1,
round(coalesce(avg((coalesce(rank, 99) < 5)::INT), 0), 6) AS recall_5, round(coalesce(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 0), 6) AS mrr FROM best)"""
sql("sweep_chunking", f"WITH RECURSIVE {DOCS}, {QUESTIONS}, {GOLD}, {', '.join(STRATEGIES.values())} " + " UNION ALL ".join([SWEEP.format(chunks=v, bm25=bm25(), name=k) for k, v in WHOLE.items()]))
sql("case_outcomes", f"WITH {OUTCOMES} SELECT qid, rank, pool_rank, pool_rank AS pool_rank_chunk FROM outcomes")
sql("recall_at_k", f"WITH {OUTCOMES} SELECT n, recall_1, recall_3, recall_5, recall_10 FROM summary")
sql("mrr", f"WITH {OUTCOMES} SELECT mrr FROM summary")
sql("pool_recall", f"WITH {OUTCOMES} SELECT pool_recall FROM summary")
sql("eval_summary", f"WITH {OUTCOMES} SELECT * FROM summary")
FACTS = f"""{BASE}, ctx AS (SELECT qid, string_agg(c.text, chr(10) ORDER BY rank) AS t FROM lex JOIN chunks c USING (chunk_ord) WHERE rank <= 5 GROUP BY 1),
facts AS (SELECT qid, (CASE WHEN qid % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS n_facts, contains(coalesce(t, ''), query)::BIGINT + (CASE WHEN qid % 3 = 0 THEN contains(coalesce(t, ''), 'never said')::BIGINT ELSE 0 END) AS n_found, query, t FROM questions LEFT JOIN ctx USING (qid))"""
sql("fact_recall", f"WITH {FACTS} SELECT qid, n_facts, n_found, round(n_found::DOUBLE / n_facts, 6) AS fact_recall, (n_found = n_facts)::BIGINT AS fact_complete FROM facts")
sql("missing_facts", f"WITH {FACTS} SELECT qid, concat_ws('|', CASE WHEN NOT contains(coalesce(t, ''), query) THEN query END, CASE WHEN qid % 3 = 0 THEN 'never said' END) AS missing FROM facts WHERE n_found < n_facts")
CASES = f"""{GOLD}, c AS (SELECT 'c' || (b.item_id // 2) AS case_id, b.item_id AS ord, b.text AS question, CASE b.item_id % 7 WHEN 3 THEN 'partial' WHEN 5 THEN 'refuse' END AS expect,
  list_concat(coalesce((SELECT list(g.doc_id::VARCHAR) FROM gold_pairs g WHERE g.qid = b.item_id), []), CASE WHEN b.item_id % 5 = 1 THEN ['nowhere'] ELSE [] END) AS ids, CASE WHEN b.item_id % 4 = 2 THEN 'never said' ELSE b.text END AS must, b.item_id % 6 = 4 AS blank FROM benchmark b)"""
sql("gold_lint", f"""WITH {CASES}
SELECT case_id, 'duplicate id' AS problem, '' AS about FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS r FROM c) WHERE r > 1
UNION ALL SELECT case_id, 'blank note', '' FROM c WHERE blank UNION ALL SELECT case_id, 'unknown document', 'nowhere' FROM c WHERE list_contains(ids, 'nowhere')
UNION ALL SELECT case_id, 'fact not in gold documents', must FROM c WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN gold_pairs g USING (doc_id) WHERE g.qid = c.ord AND contains(d.text, must))
UNION ALL SELECT case_id, 'refusal with facts', '' FROM c WHERE coalesce(expect, CASE WHEN len(ids) > 0 THEN 'answer' ELSE 'refuse' END) = 'refuse'
UNION ALL SELECT case_id, 'partial with documents', '' FROM c WHERE expect = 'partial' AND len(ids) > 0""")
EXPECTED = "coalesce(expect, CASE WHEN len(ids) > 0 THEN 'answer' ELSE 'refuse' END)"
sql("case_slice", f"WITH {CASES}, r AS (SELECT * FROM c WHERE {EXPECTED} <> 'answer'), f AS (SELECT min(ord) AS first FROM r WHERE case_id = 'c3') SELECT case_id, ord FROM r, f WHERE first IS NULL OR ord >= first ORDER BY ord LIMIT 10")
sql("diag_answer_chunks", f"WITH {DOCS}, {windows(300, 60)}, {GOLD} SELECT g.qid, count(*) AS n_chunks, count(*) FILTER (WHERE contains(c.text, b.text)) AS n_answer FROM gold_pairs g JOIN chunks c ON c.doc_ord = g.doc_id JOIN benchmark b ON b.item_id = g.qid GROUP BY 1")
sql("diag_ranks", f"WITH {BOTH}, {GOLD} SELECT g.qid, min(lex.rank) AS bm25_rank, min(sem.rank) AS vector_rank FROM gold_pairs g LEFT JOIN lex ON lex.qid = g.qid AND lex.chunk_ord = g.doc_id LEFT JOIN sem ON sem.qid = g.qid AND sem.chunk_ord = g.doc_id GROUP BY 1")
SCORES = f"{BASE}, {GOLD}, top AS (SELECT qid, qid IN (SELECT qid FROM gold_pairs) AS answerable, max_by(score, -rank) AS top1, round(max_by(score, -rank) - max_by(score, rank), 6) AS gap FROM lex WHERE rank <= 5 GROUP BY qid), ends AS (SELECT min(top1) FILTER (WHERE answerable) AS lo, max(top1) FILTER (WHERE NOT answerable) AS hi FROM top)"
sql("calibrate", f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY answerable ORDER BY top1) - 1 AS i, count(*) OVER (PARTITION BY answerable) AS n FROM top)
SELECT answerable, count(*) AS n, min(top1) AS min_top1, max(CASE WHEN i = n // 2 THEN top1 END) AS median_top1, max(top1) AS max_top1, round(avg(gap), 6) AS mean_gap, any_value(CASE WHEN lo > hi THEN round((lo + hi) / 2, 6) END) AS threshold FROM r, ends GROUP BY 1""")
sql("calibrate_overlap", f"WITH {SCORES} SELECT qid AS case_id, answerable, top1 FROM top, ends WHERE (answerable AND top1 <= hi) OR (NOT answerable AND top1 >= lo)")
sql("refuse_threshold", f"WITH {BASE} SELECT qid AS case_id, score < 60 AS insufficient FROM lex WHERE rank = 1")
sql("evidence_block", f"WITH {BASE} SELECT qid, md5(string_agg('【片段 ' || chunk_ord || '】' || chr(10) || c.text, chr(10) || chr(10) ORDER BY rank)) AS block_md5 FROM lex JOIN chunks c USING (chunk_ord) WHERE rank <= 3 GROUP BY 1")

# Answers: one for each (item, document) of gold, changed by r = (item + document) mod 7.
ANSWERS = f"""{GOLD}, a AS (SELECT b.item_id AS qid, g.doc_id, b.text AS query, (b.item_id + coalesce(g.doc_id, 0)) % 7 AS r, b.item_id || '-' || coalesce(g.doc_id::VARCHAR, 'none') AS answer_id FROM benchmark b LEFT JOIN gold_pairs g ON g.qid = b.item_id),
ans AS (SELECT *, (doc_id IS NULL AND r <> 0) OR r = 5 AS refused, doc_id IS NOT NULL AND r <> 6 AS claimed, doc_id IS NULL AS insufficient FROM a),
num AS (SELECT answer_id, string_agg(n, '、' ORDER BY i) AS ns FROM (SELECT answer_id, doc_id, unnest(l) AS n, generate_subscripts(l, 1) AS i FROM (SELECT answer_id, doc_id, regexp_extract_all(query || CASE WHEN r = 3 THEN ' 98765.5' ELSE '' END, '\\d+(?:\\.\\d+)?') AS l FROM ans WHERE claimed AND r <> 1)) x
  JOIN documents d ON d.doc_id = x.doc_id WHERE NOT contains(d.text, n) GROUP BY 1),
issues AS (
  SELECT answer_id, 0 AS ord, 'refusal.required' AS rule, 'error' AS severity, 'refused' AS path, '{MESSAGES["refusal.required"]}' AS message, '' AS detail FROM ans WHERE insufficient AND NOT refused
  UNION ALL SELECT answer_id, 1, 'refusal.with-claims', 'error', 'claims', '{MESSAGES["refusal.with-claims"]}', '' FROM ans WHERE refused AND claimed
  UNION ALL SELECT answer_id, 2, 'refusal.no-reason', 'warn', 'refusalReason', '{MESSAGES["refusal.no-reason"]}', '' FROM ans WHERE refused AND r = 2
  UNION ALL SELECT answer_id, 3, 'claims.empty', 'error', 'claims', '{MESSAGES["claims.empty"]}', '' FROM ans WHERE NOT refused AND NOT claimed
  UNION ALL SELECT answer_id, 10, 'cite.unknown-chunk', 'error', 'claims[0]', '{MESSAGES["cite.unknown-chunk"].replace("%s", "nowhere")}', '' FROM ans WHERE claimed AND r = 1
  UNION ALL SELECT answer_id, 11, 'quote.not-substring', 'error', 'claims[0]', '{MESSAGES["quote.not-substring"]}', substr(query || ' never said', 1, 60) FROM ans WHERE claimed AND r = 2
  UNION ALL SELECT answer_id, 12, 'number.unsupported', 'error', 'claims[0]', replace('{MESSAGES["number.unsupported"]}', '%s', ns), substr(query || CASE WHEN r = 3 THEN ' 98765.5' ELSE '' END, 1, 60) FROM ans JOIN num USING (answer_id)
  UNION ALL SELECT answer_id, 2000000000, 'summary.unclaimed-number', 'warn', 'summary', '{MESSAGES["summary.unclaimed-number"].replace("%s", "424242")}', '' FROM ans WHERE r = 4 AND doc_id IS NOT NULL AND NOT refused),
verdicts AS (SELECT answer_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warn') AS warns, claimed::BIGINT AS claims, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM ans LEFT JOIN issues USING (answer_id) GROUP BY answer_id, claimed)""".replace("\\\\", "\\")
for name, rules in (("attr_refusal", ("refusal.required", "refusal.with-claims", "refusal.no-reason", "claims.empty")), ("attr_unknown_chunk", ("cite.unknown-chunk",)), ("attr_quote", ("quote.not-substring",)), ("attr_number", ("number.unsupported",)), ("attr_summary", ("summary.unclaimed-number",))):
    sql(name, f"WITH {ANSWERS} SELECT answer_id, rule, severity, path, message, detail FROM issues WHERE rule IN ({', '.join(repr(r) for r in rules)})")
sql("answer_intake", f"""WITH {ANSWERS}, m AS (SELECT *, (qid + coalesce(doc_id, 0)) % 11 AS m FROM ans),
x AS (SELECT *, CASE WHEN m = 0 THEN 'malformed' WHEN m = 1 THEN 'refused: type' WHEN m = 2 AND claimed THEN 'claims[0].quote: short' WHEN m = 3 THEN 'gaps: missing' WHEN m = 4 THEN 'not an object'
  WHEN m = 5 AND claimed THEN 'claims[0].text: missing' WHEN m = 6 THEN 'gaps[0]: type' ELSE '' END AS reasons FROM m)
SELECT answer_id, reasons, CASE WHEN reasons = '' THEN refused END AS refused, CASE WHEN reasons = '' AND r <> 2 THEN 'no evidence' END AS refusal_reason, CASE WHEN reasons = '' THEN claimed::BIGINT END AS n_claims,
  CASE WHEN reasons = '' THEN CASE WHEN claimed THEN CASE WHEN r = 1 THEN 'nowhere' ELSE doc_id::VARCHAR END || '/' || query || CASE WHEN r = 2 THEN ' never said' ELSE '' END ELSE '' END END AS quotes FROM x""")
sql("attr_verdict", f"WITH {ANSWERS} SELECT * FROM verdicts")
sql("attr_rule_hist", f"WITH {ANSWERS} SELECT rule, count(*) AS n FROM issues WHERE severity = 'error' GROUP BY 1")
sql("repair_text", f"""WITH {ANSWERS}, e AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY ord) AS i FROM issues WHERE severity = 'error')
SELECT answer_id, '{REPAIR_HEAD}' || chr(10) || string_agg(i || '. [' || rule || '] ' || path || ': ' || message, chr(10) ORDER BY i) || chr(10) || '{REPAIR_TAIL}' AS repair FROM e GROUP BY 1""")
sql("attr_report", f"""WITH {ANSWERS} SELECT answer_id, CASE WHEN passed THEN '✅ 归因校验通过（' || claims || ' 条断言逐条溯源，' || warns || ' 条提醒）' ELSE '❌ 归因校验未通过：' || errors || ' 个错误 / ' || warns || ' 条提醒' END AS head FROM verdicts""")
RUNS = f"""{ANSWERS}, runs AS (SELECT run, answer_id AS case_id, expected, refused, CASE expected WHEN 'answer' THEN NOT refused WHEN 'refuse' THEN refused ELSE refused OR r = 3 END AS honest, errors, CASE WHEN r = 2 THEN 2 WHEN r = 4 AND run = 1 THEN 1 ELSE 0 END AS rounds, 0.25::DOUBLE AS cost
FROM (SELECT run, answer_id, r, CASE WHEN insufficient THEN CASE WHEN qid % 2 = 0 THEN 'refuse' ELSE 'partial' END ELSE 'answer' END AS expected, CASE WHEN run = 2 AND r = 4 THEN NOT refused ELSE refused END AS refused, errors FROM ans JOIN verdicts USING (answer_id), range(3) t(run)))"""
sql("answer_honesty", f"WITH {RUNS} SELECT run::INT AS run, case_id, expected, honest FROM runs")
CLEAN = "rounds = 0 AND errors = 0"
RATES = f"""count(*) AS n, count(*) FILTER (WHERE honest) AS n_honest, count(*) FILTER (WHERE expected = 'refuse' AND refused) AS refuse_ok, count(*) FILTER (WHERE expected = 'partial' AND honest) AS partial_ok,
count(*) FILTER (WHERE expected = 'answer' AND NOT refused) AS answered, count(*) FILTER (WHERE expected = 'partial' AND refused) AS conservative, count(*) FILTER (WHERE expected = 'answer' AND {CLEAN}) AS clean, round(sum(cost), 6) AS cost"""
sql("answer_rates", f"WITH {RUNS} SELECT run::INT AS run, {RATES} FROM runs GROUP BY 1 UNION ALL SELECT NULL, {RATES} FROM runs")
sql("run_stability", f"""WITH {RUNS}, x AS (SELECT run, coalesce(avg(honest::INT) FILTER (WHERE expected = 'refuse'), 1) AS honest, coalesce(avg(({CLEAN})::INT) FILTER (WHERE expected = 'answer'), 1) AS clean FROM runs GROUP BY 1)
SELECT round(avg(honest), 6) AS honest_mean, round(stddev_pop(honest), 6) AS honest_sd, round(avg(clean), 6) AS clean_mean, round(stddev_pop(clean), 6) AS clean_sd, count(*) AS runs FROM x""")
sql("flaky_cases", f"""WITH {RUNS} SELECT case_id, count(*) AS n, count(*) FILTER (WHERE honest) AS n_honest, count(*) FILTER (WHERE {CLEAN}) AS n_clean FROM runs GROUP BY 1
HAVING count(*) >= 2 AND (count(DISTINCT honest) > 1 OR count(DISTINCT ({CLEAN})) > 1)""")
