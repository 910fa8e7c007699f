"""The registry's queries in DuckDB's SQL."""

from __future__ import annotations

from foliospark.functions.text import STOP_WORDS, TOKEN
from foliospark.operators.models import DIMENSIONS
from foliospark.plans.registry import CATEGORY, QUERY_EVERY, QUESTION, TOPIC, TOPICS
from foliospark.sources.tables import NULL_CELLS


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _clean(c: str, pattern: str = r"[\s\p{Z}]+") -> str:
    return _strip(f"regexp_replace(replace(coalesce({c}, ''), chr(10), ' '), '{pattern}', ' ', 'g')")


def _day(c: str) -> str:
    return f"case when regexp_matches({_strip(c)}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_strptime({_strip(c)}, '%Y-%m-%d')::date end"


def _blank(c: str) -> str:
    return f"{_strip(f'coalesce({c}, {chr(39)}{chr(39)})')} = ''"


def _csv_cell(c: str) -> str:
    return f"case when {c} not in ({', '.join(f"'{x}'" for x in NULL_CELLS)}) then {c} end"


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
CLEAN = f"""select record_id, arxiv_id, {_clean('title')} as title_clean, {_clean('summary')} as abstract_clean,
 {_clean('title')} || '. ' || {_clean('summary')} as text_unit, authors, {_day('published')} as published, {_day('updated')} as updated,
 primary_category, pdf_url from paper_metadata"""


def _words(c: str, stop: bool) -> str:
    found = f"regexp_extract_all(lower(coalesce({c}, '')), '{TOKEN}')"
    return f"list_filter({found}, lambda w: w not in ({STOP}))" if stop else found


def _terms_of(docs: str, key: str, column: str) -> str:
    """Words and pairs of a document, with counts."""
    return f"""words as (select {key}, {_words(column, True)} as w from ({docs})),
 terms as (select {key}, unnest(w) as term from words union all
  select {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from words),
 counts as (select {key}, term, count(*) as tf from terms group by all),
 vocab as (select term, count(*) as df from counts group by term order by sum(tf) desc, term limit 20000),
 raw as (select {key}, term, tf * (ln((1 + (select count(*) from ({docs}))) / (1 + df)) + 1) as w from counts join vocab using (term)),
 weights as (select {key}, term, w / sqrt(sum(w * w) over (partition by {key})) as w from raw)"""


def _top_terms(docs: str, key: str, column: str, group: str) -> str:
    return f"""{_terms_of(docs, key, column)},
 sizes as (select {group}, count(*) as size from ({docs}) group by 1),
 means as (select {group}, term, round(sum(w) / any_value(size), 6) as weight from weights join ({docs}) d using ({key}) join sizes using ({group}) group by 1, 2),
 ranked as (select {group}, term, weight, row_number() over (partition by {group} order by weight desc, term) as rank from means)"""


HITS = """hits as (select e.vec_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 6) as similarity
  from embeddings e, (select embedding from embeddings where vec_id = 0) q order by similarity desc, e.vec_id limit 10),
 shown as (select h.vec_id, h.similarity, split_part(d.text, chr(10), 1) as title,
  case when contains(d.text, chr(10)) then substr(d.text, strpos(d.text, chr(10)) + 1) end as body,
  'https://papers.example/pdf/' || d.arxiv_id as pdf_url from hits h join documents d on d.doc_id = h.vec_id),
 chunks as (select *, 'TITLE: ' || coalesce(title, 'Untitled') || chr(10) || 'CONTENT: ' || coalesce(body, '') || chr(10) as chunk from shown),
 kept as (select * from (select *, coalesce(sum(length(chunk)) over (order by similarity desc, vec_id rows between unbounded preceding and 1 preceding), 0) as before from chunks) where before <= 2500),
 ctx as (select left(coalesce(string_agg(chunk, chr(10) || '---' || chr(10) order by similarity desc, vec_id), ''), 2500) as context, count(*) as n_chunks from kept)"""

PREVIEW = "case when length(context) > 800 then left(context, 800) || '...' else context end"

SQL: dict[str, str] = {
    "clean_corpus": f"select * replace (published::varchar as published, updated::varchar as updated) from ({CLEAN})",
    "clean_corpus_strict": f"select record_id, {_clean('title', 's' + chr(92) + '+')} as title_clean, {_clean('summary', 's' + chr(92) + '+')} as abstract_clean from paper_metadata",
    "ingest_clean": f"""select record_id, coalesce(nullif(regexp_extract(arxiv_id, 'abs/(.+)$', 1), ''), arxiv_id) as short_id,
 replace({_strip("coalesce(title, '')")}, chr(10), ' ') as title, replace({_strip("coalesce(summary, '')")}, chr(10), ' ') as summary from paper_metadata""",
    "parse_dates": f"select record_id, published::varchar as published, updated::varchar as updated, coalesce(strftime(updated, '%Y-%m-%d'), '') as updated_text from ({CLEAN})",
    "topics_per_run": "select run_id, coalesce(string_agg(topic_id::varchar, ', ' order by topic_row), '') as topics from topics group by run_id",
    "choose_text_column": "select case when coalesce(bool_or(summary is not null), false) then 'summary' else 'text_unit' end as text_col, count(*) as n from corpus_with_topics",
    "nonempty_filter": f"select record_id, length(summary)::bigint as n_chars from paper_metadata where not ({_blank('summary')})",
    "display_fallbacks": f"""select arxiv_id, coalesce(title_clean, '') as show_title, coalesce(abstract_clean, '') as show_abstract, coalesce(summary, '') as show_summary,
 coalesce(nullif(summary, ''), nullif(abstract_clean, ''), nullif(text_unit, ''), '') as body,
 case when {_blank('authors')} then 'Unknown authors' else authors end || case when {_blank('published')} then '' else ' | ' || published::varchar end as meta,
 not ({_blank('pdf_url')}) as has_link, {_strip("coalesce(abstract_clean, '')")} = {_strip("coalesce(summary, '')")} as summary_is_abstract from corpus_with_topics""".replace(_blank("published"), "published is null"),
    "row_index": f"select record_id, title, published, updated, pdf_url, row_number() over (order by record_id) - 1 as row_idx, 'summary' as embedded_text_col, 'hashing-64' as embedding_model from paper_metadata where not ({_blank('summary')})",
    "newest_first_limit": f"select record_id, published::varchar as published, title_clean from ({CLEAN}) order by published desc nulls last, record_id limit 20",
    "category_filter": f"select record_id, published::varchar as published, primary_category from ({CLEAN}) where primary_category = '{CATEGORY}' order by published desc nulls last, record_id limit 20",
    "keyword_search": "select record_id, title from paper_metadata where contains(lower(coalesce(title, '')), 'neutron star') or contains(lower(coalesce(summary, '')), 'neutron star') or contains(lower(coalesce(authors, '')), 'neutron star') order by record_id limit 10",
    "keyword_search_regex": "select record_id, title from paper_metadata where regexp_matches(lower(coalesce(title, '')), '(light|yield) curve[s.,]') or regexp_matches(lower(coalesce(summary, '')), '(light|yield) curve[s.,]') or regexp_matches(lower(coalesce(authors, '')), '(light|yield) curve[s.,]') order by record_id limit 10",
    "keyword_empty_query": "select record_id, title from paper_metadata order by record_id limit 10",
    "topic_sizes": f"select r.id as topic_id, count(c.topic_id) as doc_count from range({TOPICS}) r(id) left join corpus_with_topics c on c.topic_id = r.id group by 1",
    "topic_browse": f"select arxiv_id, run_id, title_clean, published::varchar as published, pdf_url from corpus_with_topics where topic_id = {TOPIC} order by arxiv_id nulls first, run_id nulls first, title_clean nulls first, published nulls first, pdf_url nulls first limit 30",
    "topic_list": "select topic_id, sum(greatest(coalesce(doc_count, 0), 0))::bigint as doc_count from topics where topic_id is not null group by 1",
    "l2_normalize": """select vec_id, unnest(range(1, len(embedding) + 1)) as pos, unnest(list_transform(embedding, lambda v: round(v::double / n, 6))) as value
 from (select vec_id, embedding, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings) where n > 0""",
    "dot_all": "select e.vec_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 6) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q",
    "semantic_top_k": f"with {HITS} select vec_id as doc_id, similarity, title from shown",
    "semantic_top_k_batch": f"""select * from (select query_id, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from (
 select q.vec_id as query_id, e.vec_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 6) as similarity
 from embeddings e, embeddings q where q.vec_id % {QUERY_EVERY} = 0)) where rank <= 5""",
    "centroids": "select label, pos, round(avg(v), 6) as weight from (select label, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as v from embeddings where label is not null) group by all",
    "assign_nearest": """with means as (select label, list(weight order by pos) as mean from (select label, pos, round(avg(v), 6) as weight from
  (select label, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as v from embeddings where label is not null) group by all) group by label)
 select vec_id, label as topic_id from (select e.vec_id, m.label, row_number() over (partition by e.vec_id order by
  round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::double - m.mean[i]) * (e.embedding[i]::double - m.mean[i]))), 6), m.label) as r
  from embeddings e, means m) where r = 1""",
    "tokenize_counts": f"""select term, sum(tf)::bigint as n, count(*) as df from (select doc_id, term, count(*) as tf from
 (select doc_id, unnest({_words('text', False)}) as term from documents) group by all) group by term""",
    "bigrams": f"""with words as (select {_words('summary', True)} as w from paper_metadata)
 select bigram, count(*) as n from (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bigram from words) group by 1""",
    "tfidf_topterms": f"with {_top_terms(f'select * from ({CLEAN}) where primary_category is not null', 'record_id', 'text_unit', 'primary_category')} select primary_category, term, weight, rank from ranked where rank <= 10",
    "topic_keywords": f"""with {_top_terms('select * from documents where section is not null', 'doc_id', 'text', 'section')},
 joined as (select section, string_agg(term, ', ' order by rank) as keywords from ranked where rank <= 10 group by 1)
 select section, size as doc_count, coalesce(keywords, '') as keywords, 'text' as text_col from sizes left join joined using (section)""",
    "rag_context": f"with {HITS} select context, n_chunks, length(context)::bigint as n_chars from ctx",
    "rag_sources": f"with {HITS} select coalesce(title, 'Untitled') as title, similarity, coalesce(pdf_url, '') as pdf_url from kept",
    "rag_top_sources": f"with {HITS} select row_number() over (order by similarity desc, vec_id) as rank, coalesce(title, 'Untitled') as title, similarity, coalesce(pdf_url, '') as pdf_url from kept order by rank limit 3",
    "store_metadata": "select arxiv_id, title, summary, authors, published, updated, primary_category, pdf_url from paper_metadata",
    "store_clean": f"select * exclude (record_id) replace (published::varchar as published, updated::varchar as updated) from ({CLEAN})",
    "store_best_corpus": f"""with lead as (select *, array_to_string(list_slice(string_split({_clean('text_unit')}, ' '), 1, 40), ' ') as l from ({CLEAN}))
 select * exclude (record_id, l) replace (published::varchar as published, updated::varchar as updated), coalesce(nullif(regexp_extract(l, '^((?:[^ ]+ ){{11,}}[^ ]*[.!?])(?: |$)', 1), ''), l) as summary from lead""",
    "store_embeddings": f"select arxiv_id, title_clean as title, published::varchar as published, updated::varchar as updated, pdf_url, 'text_unit' as embedded_text_col, 'hashing-64' as embedding_model, {DIMENSIONS}::bigint as dimensions from ({CLEAN}) where not ({_blank('text_unit')})",
    "store_topics_csv": f"select topic_row, run_id, topic_id, doc_count, {_csv_cell('keywords')} as keywords, {_csv_cell('text_col')} as text_col from topics",
    "store_corpus_with_topics": f"select arxiv_id, run_id, title_clean, topic_id::bigint as topic_id from corpus_with_topics where topic_id = {TOPIC}",
    "context_preview": f"with {HITS} select {PREVIEW} as context_preview from ctx",
    "answer_question": f"""with {HITS},
 wanted as (select list_distinct({_words(f"'{QUESTION}'", True)}) as q),
 sentences as (select s, row_number() over () as i from (select unnest(list_filter(regexp_split_to_array(context, '[\\n]+|(?:[.!?] +)'), lambda s: s != '')) as s from ctx)),
 scored as (select s, i, len(list_intersect(q, {_words('s', False)})) as n, len(q) as size from sentences, wanted),
 best as (select * from scored where n > 0 order by n desc, i limit 1)
 select coalesce(regexp_replace(left(s, 400), '[.!?]+$', ''), '') as answer, coalesce(round(n / size, 6), 0.0)::double as score, (select count(*) from kept) as n_sources, {PREVIEW} as context_preview,
 case when n_chunks = 0 then 'No relevant context was found.' end as error from ctx left join best on true""",
    "summarize_docs": f"""with lead as (select record_id, array_to_string(list_slice(string_split({_clean('text_unit')}, ' '), 1, 40), ' ') as l from ({CLEAN}))
 select record_id, coalesce(nullif(regexp_extract(l, '^((?:[^ ]+ ){{11,}}[^ ]*[.!?])(?: |$)', 1), ''), l) as model_summary from lead""",
    "embed_docs": f"""with words as (select record_id, md5(w) as h from (select record_id, unnest({_words('summary', False)}) as w from paper_metadata)),
 sums as (select record_id, ('0x' || substr(h, 1, 7))::bigint % {DIMENSIONS} as pos, sum(case when ('0x' || substr(h, 8, 1))::int % 2 = 0 then 1 else -1 end)::double as v from words group by 1, 2)
 select record_id, pos, round(v / sqrt(sum(v * v) over (partition by record_id)), 6) as value from sums where v != 0""",
}
