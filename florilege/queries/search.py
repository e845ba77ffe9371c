"""Retrieval queries: full text, fusion, chunks, snippets, look-ups, text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fulltext as T
from ..operators import matching as M
from ..session import stash, table
from ..sources import records as R
from ..sources import vault as V

QUESTIONS = [(1, "insulin signalling mice"), (2, "mitochondrial dynamics"), (3, "fasting torpor"), (4, "obesity trial women"), (5, "macrophage lipid"), (6, "!!")]


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query int, text string")


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "journal")
    return T.search(docs, _questions(spark), "doc_id", {"text": 1.0, "journal": 2.0})


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Full-text ranking (weight 2) fused with the newest documents that hold the question's first word (weight 1)."""
    docs = table(spark, d, "documents").select("doc_id", "text", "journal", "added_at")
    q = _questions(spark)
    a = T.search(docs, q, "doc_id", {"text": 1.0, "journal": 2.0}).select("query", "doc_id", "rank", F.lit(2.0).alias("weight"))
    first = q.select("query", F.get(T.tokens("text"), F.lit(0)).alias("w")).where("w is not null")
    hit = docs.select("doc_id", "added_at", F.explode(F.array_distinct(T.tokens("text"))).alias("w")).join(F.broadcast(first), "w")  # one word a question
    b = hit.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("added_at"), "doc_id"))).where("rank <= 20")
    return T.fuse_ranks(a.unionByName(b.select("query", "doc_id", "rank", F.lit(1.0).alias("weight"))), "doc_id")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates, each judged by its best chunk (share of the question's words in it), place and judgement blended."""
    fused = rrf_fusion(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text").join(fused.select("doc_id").distinct(), "doc_id")
    chunks = T.chunk_text(docs, "doc_id", "text").select("doc_id", "seq", T.tokens("text").alias("ws"))
    q = _questions(spark).select("query", F.array_distinct(T.tokens("text")).alias("ts"))
    share = F.size(F.array_intersect("ts", "ws")) / F.size("ts")
    best = fused.join(q, "query").join(chunks, "doc_id").groupBy("query", "doc_id").agg(F.max(F.struct(F.round(share, 6).alias("s"), (-F.col("seq")).alias("i"))).alias("b"))
    out = fused.join(best, ["query", "doc_id"], "left").withColumn("judged", F.coalesce("b.s", F.lit(0.0)))
    out = T.blend(out, F.col("judged"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("blended"), "doc_id"))
    return out.select("query", "doc_id", "rank", "judged", (-F.col("b.i")).alias("chunk"), "blended", place.alias("place")).where("place <= 10")


def strong_signal(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose first hit leaves the second far behind, so that no expansion is needed."""
    r = bm25_search(spark, d)
    g = r.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.count("*").alias("hits"))
    return g.select("query", "first", "second", "hits", ((F.col("first") >= 0.85) & (F.round(F.col("first") - F.col("second"), 6) >= 0.15)).alias("strong"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return T.chunk_text(table(spark, d, "documents"), "doc_id", "text").drop("text")


def document_snippets(spark: SparkSession, d: str) -> DataFrame:
    s = T.snippets(table(spark, d, "documents").select("doc_id", "text"), "text", ["insulin", "mice", "fasting"])
    return s.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2("snippet", 256).alias("sha"))


def title_in_body(spark: SparkSession, d: str) -> DataFrame:
    """Saved titles of three and more words that stand in a document, letter by letter but for case.

    The inner words of a title must be words of the document in a row, so titles
    and documents meet on up to eight of them, around the most telling one (with
    letters and digits, then the longest), and only such pairs are compared.
    """
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("body"))
    t = table(spark, d, "papers").select("id", F.lower("title").alias("title"), T.tokens("title").alias("ws")).where(F.size("ws") >= 3)
    inner = F.slice("ws", 2, F.size("ws") - 2)
    telling = F.array_max(F.transform(inner, lambda x, i: F.struct((x.rlike("[a-z]") & x.rlike("[0-9]")).alias("c"), F.length(x).alias("n"), x.alias("x"), i.alias("i"))))["i"]
    t = stash(t.select("id", "title", T.run_around(inner, telling).alias("run")))
    hit = T.meet_runs(docs.select("doc_id", T.tokens("body").alias("words")), t.select("id", "run"), "doc_id", "id")
    hit = stash(hit.join(t.select("id", "title"), "id"))
    return hit.join(docs, "doc_id").where(F.contains("body", "title")).select("id", "doc_id")


def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Library and export titles that share at least 0.6 of the content words of the longer one."""
    p = table(spark, d, "papers").select("id", X.content_words("title").alias("ws"))
    e = table(spark, d, "endnote_records").select(F.col("rec_no"), X.content_words("title").alias("ws"))
    return M.similar_sets(p, e, "id", "rec_no", "ws", 0.6).select("id", "rec_no", F.round("overlap", 6).alias("sim"))


def findings_from_text(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "digest_papers").where(X.blank_to_null("abstract").isNotNull()).select("id", X.findings("abstract").alias("f"))
    return df.select("id", F.size("f").cast("long").alias("n"), X.cut_with_dots(F.element_at(F.when(F.size("f") > 0, F.col("f")), 1)).alias("first"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "papers").where(F.col("full_text_summary").isNotNull())
    t = X.strip_tags("full_text_summary")
    return df.select("id", t.alias("text"), X.word_count(t).cast("long").alias("words"))


def html_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", X.sanitize("full_text_summary").alias("html"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Notes with front matter: title, year, body hash, words below it."""
    n = V.parse_notes(table(spark, d, "documents").where(F.col("text").startswith("---\n")).select("doc_id", "text"))
    return n.select("doc_id", "title", "journal", "year", "body_sha", F.col("words").cast("long").alias("words"), "has_full_text")


def body_changes(spark: SparkSession, d: str) -> DataFrame:
    """Re-indexing: notes against the hashes kept for the rows added before 2023."""
    n = V.parse_notes(table(spark, d, "documents").where(F.col("source") == "vault").select("doc_id", "text", "added_at"))
    known = n.where(F.col("added_at") < "2023-01-01").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("body_sha")).alias("body_sha"))
    return V.changed(n.select("doc_id", "body_sha"), known, "doc_id", "body_sha").groupBy("change").agg(F.count("*").alias("n"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the path and the short id under which they can be asked for."""
    name = F.concat(F.coalesce("paper_id", F.lit("note")), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", "text", F.substring("hash", 1, 6).alias("docid"), F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("journal", F.lit("none")), name).alias("path"))


def doc_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth document asked for by short id, address, end of its path, or a name nobody has."""
    docs = _paths(spark, d)
    k = F.col("doc_id") / 20 % 4
    ask = F.when(k == 0, F.concat(F.lit("#"), "docid")).when(k == 1, F.concat(F.lit("lib://"), "path")).when(k == 2, F.substring_index("path", "/", -2)).otherwise(F.concat(F.lit("no/such/"), F.col("doc_id").cast("string")))
    return T.find_documents(docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("ask"), ask.alias("name")), docs, "ask", "name", "doc_id")


#: What is asked for at once: patterns, and a list of names of which one is missing.
ASKED = [(1, "vault/**"), (2, "*/none/note-?.md"), (3, "{grant_abstract,lab_log}/Annals*/*.md"), (4, "no/such/file.md, none")]


def multi_get(spark: SparkSession, d: str) -> DataFrame:
    """Documents by patterns and lists: returned, skipped above 10 KB, or not found."""
    return T.get_many(spark.createDataFrame(ASKED, "ask int, names string"), _paths(spark, d), "doc_id", "path", "text")


CONTEXTS = [("", "everything"), ("vault", "notes"), ("vault/Annals", "notes on the Annals"), ("abstract", "feeds")]


def path_contexts(spark: SparkSession, d: str) -> DataFrame:
    """All contexts whose prefix a document's path has, the general ones first."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "journal").alias("path"))
    c = F.broadcast(spark.createDataFrame(CONTEXTS, "prefix string, context string"))  # fixed, four rows
    j = docs.join(c, F.col("path").startswith(F.col("prefix")))
    return j.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("prefix"), "prefix", "context"))), lambda x: x["context"]), "; ").alias("contexts"))


def ris_export(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "papers")
    return df.select("id", F.sha2(R.ris_lines(df), 256).alias("sha"))


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "papers")
    line = V.index_row(F.col("paper_id"), F.year("pub_date"), X.author_line("authors"), F.col("journal"), X.cut_with_dots("title", 100))
    return df.select("id", line.alias("line"))


QUERIES = {f.__name__: f for f in (
    bm25_search, rrf_fusion, hybrid_search, strong_signal, chunk_documents, document_snippets, title_in_body, title_similarity, findings_from_text, html_text, html_sanitize, front_matter, body_changes, doc_lookup,
    multi_get, path_contexts, ris_export, index_rows)}

TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
BM25 = f"""with q(query, text) as (values {', '.join(f"({i}, '{t}')" for i, t in QUESTIONS)}),
  want as (select query, unnest(list_distinct({TOK.format('text')})) as prefix from q), need as (select query, count(*) as need from want group by query),
  size as (select doc_id, len({TOK.format("concat_ws(' ', text, journal)")}) as len from documents where doc_id is not null), stats as (select count(*) as n, avg(len) as avglen from size),
  words as (select doc_id, unnest({TOK.format("coalesce(text, '')")}) as term, 1.0 as w from documents union all select doc_id, unnest({TOK.format("coalesce(journal, '')")}), 2.0 from documents),
  per as (select query, prefix, doc_id, sum(w)::double as tf from words join want on starts_with(term, prefix) group by all), df as (select query, prefix, count(*) as df from per group by all),
  part as (select query, doc_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avglen)) as x from per join df using (query, prefix) join size using (doc_id), stats),
  hit as (select query, doc_id, round(sum(x), 6) as bm25, sum(x) as raw, count(*) as got from part group by all),
  bm as (select query, doc_id, bm25, round(raw / (1 + raw), 6) as score, (row_number() over (partition by query order by bm25 desc, doc_id))::int as rank from hit join need using (query) where got = need)
"""
RRF = BM25 + f""", f as (select query, {TOK.format('text')}[1] as w from q), newest as (select query, doc_id, row_number() over (partition by query order by added_at desc nulls last, doc_id) as rank from
    (select distinct doc_id, added_at, query from (select doc_id, added_at, unnest({TOK.format('text')}) as w from documents) join f using (w))),
  lists as (select query, doc_id, rank, 2.0 as weight from bm where rank <= 20 union all select query, doc_id, rank, 1.0 from newest where rank <= 20),
  fused as (select query, doc_id, round(sum(weight / (60 + rank)) + case when min(rank) = 1 then 0.05 when min(rank) <= 3 then 0.02 else 0 end, 6)::double as score from lists group by all)
  select * from (select query, doc_id, score, (row_number() over (partition by query order by score desc, doc_id))::int as rank from fused) where rank <= 40"""
WORDS = r"""list_filter(list_distinct(regexp_split_to_array(lower(title), '[^\p{L}\p{N}_]+')), lambda w: regexp_full_match(w, '[a-z]{2,}') and not list_contains(['a', 'an', 'the', 'of', 'in', 'for', 'and', 'or', 'is', 'to', 'by', 'on', 'at', 'its', 'with', 'from', 'that', 'this', 'not',
  'are', 'was', 'as', 'it', 'be', 'into', 'via', 'but'], w))"""
PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(regexp_replace(full_text_summary, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"
PATHS = """p as (select doc_id, text, substr(hash, 1, 6) as docid, concat_ws('/', coalesce(source, 'none'), coalesce(journal, 'none'), coalesce(paper_id, 'note') || '-' || doc_id || '.md') as path from documents)"""
NOTE = r"""(case when regexp_replace(regexp_replace(trim(regexp_extract(h, '(?m)^{0}:[ \t]*(.*?)[ \t\r]*$', 1)), '^"(.*)"$', '\1'), '^''(.*)''$', '\1') not in ('', 'null', '~', '[]')
  then regexp_replace(regexp_replace(trim(regexp_extract(h, '(?m)^{0}:[ \t]*(.*?)[ \t\r]*$', 1)), '^"(.*)"$', '\1'), '^''(.*)''$', '\1') end)"""
ORACLE = {
    "bm25_search": BM25 + " select query, doc_id, bm25, score, rank from bm where rank <= 20",
    "rrf_fusion": RRF,
    "strong_signal": BM25
    + """, g as (select query, max(score) filter (rank = 1) as first, coalesce(max(score) filter (rank = 2), 0.0)::double as second, count(*) filter (rank <= 20) as hits from bm group by query)
       select *, first >= 0.85 and round(first - second, 6) >= 0.15 as strong from g""",
    "title_in_body": f"select id, doc_id from papers, documents where len({TOK.format('title')}) >= 3 and contains(lower(text), lower(title))",
    "title_similarity": f"""with p as (select id, {WORDS} as pw from papers), e as (select rec_no, {WORDS} as ew from endnote_records)
        select id, rec_no, round(len(list_intersect(pw, ew)) / greatest(len(pw), len(ew)), 6) as sim from p, e where len(pw) > 0 and len(ew) > 0 and len(list_intersect(pw, ew)) / greatest(len(pw), len(ew)) >= 0.6""",
    "html_text": rf"select id, t as text, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))::bigint as words from (select id, {PLAIN} as t from papers where full_text_summary is not null)",
    "doc_lookup": f"""with {PATHS}, a as (select doc_id as ask, case (doc_id // 20) % 4 when 0 then docid when 1 then path when 2 then array_to_string(string_split(path, '/')[-2:], '/') else 'no/such/' || doc_id end as name from p where doc_id % 20 = 0),
        m as (select ask, 0 as n, p.doc_id from a join p on (ask // 20) % 4 = 0 and docid = name union all select ask, 1, p.doc_id from a join p on (ask // 20) % 4 = 1 and path = name
          union all select ask, 2, p.doc_id from a join p on (ask // 20) % 4 = 2 and (path = name or ends_with(path, '/' || name)))
        select a.ask, min(m.doc_id) as doc_id, coalesce((['docid', 'path', 'suffix'])[min(n) + 1], 'not found') as how from a left join m using (ask) group by a.ask""",
    "multi_get": rf"""with {PATHS}, h as (select 1 as ask, * from p where starts_with(path, 'vault/') union all select 2, * from p where regexp_full_match(path, '[^/]*/none/note-[^/]\.md') union all select 3, * from p where regexp_full_match(path, '(?:grant_abstract|lab_log)/Annals[^/]*/[^/]*\.md'))
        select ask, doc_id, strlen(text)::bigint as bytes, case when strlen(text) > 10240 then 'too large' else 'ok' end as result from h
        union all select 4, null, null, 'not found: no/such/file.md' union all select 4, null, null, 'not found: none'""",
    "path_contexts": f"""with c(prefix, context) as (values {', '.join(f"('{a}', '{b}')" for a, b in CONTEXTS)}) select doc_id, string_agg(context, '; ' order by length(prefix), prefix) as contexts
        from (select doc_id, concat_ws('/', source, journal) as path from documents) join c on starts_with(path, prefix) group by doc_id""",
    "ris_export": r"""select id, sha256(concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, case when len(authors) > 0 then array_to_string(list_transform(authors, lambda a: 'AU  - ' || a), chr(10)) end, 'JO  - ' || journal,
        'PY  - ' || year(pub_date), 'DA  - ' || strftime(pub_date, '%Y/%m/%d'), 'AB  - ' || abstract, 'DO  - ' || doi, 'AN  - ' || pmid, 'ER  - ')) as sha from papers""",
    "index_rows": r"""with r as (select *, list_filter(authors, lambda x: regexp_matches(x, '\S')) as a from papers) select id, concat_ws(' | ', '', coalesce(paper_id, '-'), coalesce(year(pub_date)::varchar, '-'),
        coalesce(case when len(a) > 3 then array_to_string(a[1:3], ', ') || ' et al.' when len(a) > 0 then array_to_string(a, ', ') end, '-'), coalesce(journal, '-'),
        coalesce(case when length(title) > 100 then substr(title, 1, 97) || '...' else title end, '-'), '') as line from r""",
    "front_matter": rf"""with h as (select doc_id, regexp_extract(text, '(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)', 1) as h, regexp_replace(text, '(?s)\A---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)', '') as b from documents where starts_with(text, '---' || chr(10)))
        select doc_id, {NOTE.format('title')} as title, {NOTE.format('journal')} as journal, try_cast({NOTE.format('year')} as int) as year, sha256(b) as body_sha, len(list_filter(regexp_split_to_array(b, '\s+'), lambda w: w <> ''))::bigint as words,
        len(regexp_extract_all(b, '(?m)^## ')) > 1 as has_full_text from h""",
    "body_changes": """select case when added_at < '2023-01-01' then case when doc_id % 7 = 0 and text is not null then 'changed' else 'unchanged' end else 'new' end as change, count(*) as n from documents where source = 'vault' group by 1""",
    "document_snippets": """with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        n as (select doc_id, ls, list_transform(ls, lambda s: contains(lower(s), 'insulin')::int + contains(lower(s), 'mice')::int + contains(lower(s), 'fasting')::int) as n from l),
        b as (select doc_id, ls, list_position(n, list_max(n)) - 1 as b from n)
        select doc_id, (b + 1)::bigint as line, sha256(substr(array_to_string(ls[greatest(b, 1):b + 3], chr(10)), 1, 500)) as sha from b""",
    "html_sanitize": r"""select id, coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(full_text_summary, '(?s)<!--.*?-->', '', 'g'), '(?i)<(/?)(h4|p|ul|li)(?:\s[^>]*)?/?>', chr(1) || '\1\2' || chr(2), 'g'), '<[/!?a-zA-Z][^>]*>', '', 'g'),
        '(?i)' || chr(1) || '(/?)h4' || chr(2), '<\1h4>', 'g'), '(?i)' || chr(1) || '(/?)p' || chr(2), '<\1p>', 'g'), '(?i)' || chr(1) || '(/?)ul' || chr(2), '<\1ul>', 'g'), '(?i)' || chr(1) || '(/?)li' || chr(2), '<\1li>', 'g'), '') as html from papers""",
    "findings_from_text": r"""with s as (select id, list_filter(list_transform(string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 40) as s from digest_papers where regexp_matches(abstract, '\S')),
        k as (select id, s, list_sort(list_transform(s, lambda x, i: {'k': -len(list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: list_contains(['showed', 'demonstrated', 'found', 'identified', 'reveal', 'required', 'increased', 'decreased', 'reduced', 'enhanced', 'suppressed',
          'activated', 'inhibited', 'suggest', 'indicate', 'conclude', 'significantly', 'potently', 'robustly', 'unexpectedly'], w))), 'i': i}))[1:4] as b from s), f as (select id, len(b)::bigint as n, s[list_min(list_transform(b, lambda x: x.i))] as f from k)
        select id, n, case when length(f) > 130 then substr(f, 1, 127) || '...' else f end as first from f""",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
