"""SQL for DuckDB that gives the same rows as each registered query."""

from __future__ import annotations

from checks import inputs
from tomewright import fixed_values as fv
from tomewright.functions.header import language_line
from tomewright.functions.latin import COMBINING, EXPANSIONS, LETTERS
from tomewright.operators.trees import EDGES

BLOCK = 100
LETTER = r"[^\p{L}\p{N}_]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP = ", ".join(f"({_quoted(w)})" for w in sorted(set(inputs.STOP_WORDS)))


def to_ascii(text: str) -> str:
    changed = f"translate({text}, {_quoted(''.join(LETTERS))}, {_quoted(''.join(LETTERS.values()))})"
    for char, replacement in EXPANSIONS.items():
        changed = f"replace({changed}, {_quoted(char)}, {_quoted(replacement)})"
    return f"regexp_replace({changed}, '{COMBINING}', '', 'g')"


def tokens(table: str = "documents", key: str = "doc_id", text: str = "text", rx: str = LETTER, keep_empty=False) -> str:
    split = f"select {key}, unnest(regexp_split_to_array({text}, '{rx}')) as raw from {table}"
    return (
        f"select {key}, raw, regexp_replace(lower(raw), 's$', '') as term from ({split})"
        + ("" if keep_empty else " where raw <> ''")
    )


def counts(token_sql: str, key: str = "doc_id") -> str:
    return f"select {key}, term, count(*) as n from ({token_sql}) group by all"


def weights(counted: str) -> str:
    return f"""
    counts as ({counted}),
    tops as (select doc_id, max(n) as max_n from counts group by doc_id),
    tf as (select doc_id, term, n, {fv.TF_SMOOTHING} + (1 - {fv.TF_SMOOTHING}) * n::double / max_n as tf
           from counts join tops using (doc_id)),
    total as (select count(*) as n_docs from tops),
    df as (select term, count(*) as df from counts group by term),
    idf as (select term, df, log2(n_docs::double / df) as idf from df, total),
    tfidf as (select doc_id, term, tf, idf, tf * idf as tfidf from tf join idf using (term))
"""


WEIGHTS = weights(counts(tokens()))
HASH = "('0x' || substr(md5(term), 1, 8))::bigint"
SIGN = "(case when length(term) % 2 = 1 then 1 else -1 end)"


def cells(*places: str) -> str:
    rows = " union all ".join(
        f"select doc_id, cast({place} as integer) as bucket, {SIGN} * tfidf as v from tfidf" for place in places
    )
    return f"select doc_id, bucket, round(abs(sum(v)), 6) as value from ({rows}) group by all"


START = f"(?m){inputs.FORMAT.start}"
END = f"(?m){inputs.FORMAT.end}"


def field(text: str, rx: str) -> str:
    return f"nullif(regexp_extract({text}, '(?m){rx}', 1), '')"


def split_books(copies: int = 1) -> str:
    """CTEs from edition rows to documents with all their header fields."""
    return f"""
    editions as ({inputs.editions_sql(copies)}),
    halves as (select *, regexp_split_to_array(content, '{START}') as p from editions),
    headed as (select path, p[1] as header, p[2] as rest, regexp_split_to_array(p[2], '{END}') as q
               from halves where len(p) = 2),
    fields as (select path, header, rest, case when len(q) = 2 then q[1] else rest end as cut,
                      {field('header', fv.BOOK_ID)} as book_id, {field('header', fv.CHARSET_LINE)} as charset
               from headed),
    ranked as (select *, case upper(charset) when 'UTF' then {fv.RANK_UTF} when 'ASCII' then {fv.RANK_ASCII}
                              else {fv.RANK_OTHER} end as enc_rank from fields),
    docs as (select path, header, ltrim(book_id, '#') as doc_id, cast(enc_rank as integer) as enc_rank,
                    case when charset is not null and enc_rank = {fv.RANK_OTHER} then {to_ascii('cut')} else cut end as body
             from ranked where rest <> '' and book_id is not null)
    """


RULES = (
    f"not regexp_matches(header, '(?m){fv.GENOME_LINE}') and "
    f"(regexp_matches(header, '(?m){fv.ASCII_LINE}') or regexp_matches(header, '(?m){language_line('English')}'))"
)
DOC_OUT = "path, doc_id, md5(body) as body_md5, cast(length(body) as bigint) as n_chars"

def lines_ctes(copies: int = 1) -> str:
    return f"""
    editions as ({inputs.editions_sql(copies)}),
    lines as (select path, content, unnest(string_split(content, chr(10))) as line,
                     generate_subscripts(string_split(content, chr(10)), 1) - 1 as line_no from editions),
    marks as (select path, any_value({field('content', fv.BOOK_ID)}) as book_id,
                     min(line_no) filter (regexp_matches(line, '{inputs.FORMAT.start}')) as start_at,
                     min(line_no) filter (regexp_matches(line, '{inputs.FORMAT.end}')) as end_at,
                     count(*) filter (regexp_matches(line, '{inputs.FORMAT.end}')) as n_ends
              from lines group by path),
    parts as (select path, ltrim(any_value(book_id), '#') as doc_id,
                     string_agg(line, chr(10) order by line_no) filter (line_no <= start_at) as header,
                     string_agg(line, ' ' order by line_no) filter (line_no > start_at) as body,
                     string_agg(line, ' ' order by line_no)
                         filter (line_no > start_at and (n_ends <> 1 or line_no < end_at)) as cut
              from lines join marks using (path) where start_at is not null and book_id is not null group by path),
    firsts as (select * from (select *, row_number() over (partition by doc_id order by path) as place from parts) where place = 1)
"""


LINES = lines_ctes()

METADATA = f"""
    records as (
        select {inputs.RDF_NAME} as file_name,
               case when doc_id % 11 = 0 then null else cast(doc_id as varchar) end as ebook_id,
               cast(1700 + n_chars % 250 as integer) as birth_year, 'N' || doc_id as node, lang, source, doc_id
        from documents),
    subjects as (
        select file_name, ebook_id, 0 as place, node as subject_id, lang as subject_txt from records
        union all
        select file_name, ebook_id, 1, case when doc_id % 5 = 0 then null else node end, source from records),
    extra as (select {inputs.RDF_NAME} as file_name from documents where doc_id % 9 = 0),
    top as (select subject_txt as subject, count(distinct ebook_id) as n_books from subjects
            where ebook_id is not null group by 1 order by 2 desc, 1 limit {fv.TOP_SUBJECTS})
"""
RECORDS_OUT = """
    select file_name, ebook_id, birth_year, cast(2 as bigint) as n_subjects from records
    union all select file_name, null, null, 0 from extra
"""
STOPPED = "raw not in (select w from stop) and term not in (select w from stop)"
LOWER_STOPPED = STOPPED.replace("raw", "lower(raw)").replace("select w", "select lower(w)")


def _sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # Words and counts
    sql["word_tokens"] = tokens()
    sql["word_tokens_ascii"] = tokens(rx=fv.ASCII_SEPARATOR, keep_empty=True)
    sql["term_counts"] = counts(tokens())
    sql["term_counts_ascii"] = counts(tokens(rx=fv.ASCII_SEPARATOR, keep_empty=True))
    stop = f"with stop(w) as (values {STOP}) "
    sql["stop_filtered_counts"] = stop + counts(f"{tokens()} and {STOPPED}")
    sql["stop_filtered_ignore_case"] = stop + counts(f"{tokens()} and {LOWER_STOPPED}")
    sql["stop_filtered_simple"] = stop + counts(
        f"{tokens(rx=fv.ASCII_SEPARATOR, keep_empty=True)} where term not in (select w from stop)"
    )
    listed = f"select unnest(regexp_split_to_array(line, '{fv.ASCII_SEPARATOR}')) from " \
             "(select unnest(string_split(text, chr(10))) as line from benchmark)"
    sql["stop_list_words"] = f"with words(word) as ({listed}) select distinct word from words"
    sql["stop_filtered_long_list"] = f"with stop(w) as ({listed}) " + counts(f"{tokens()} and {STOPPED}")
    sql["stop_filtered_list_ignore_case"] = f"with stop(w) as ({listed}) " + counts(f"{tokens()} and {LOWER_STOPPED}")
    sql["stop_filtered_file"] = sql["stop_filtered_long_list"]
    sql["min_term_length"] = f"select * from ({counts(tokens())}) where length(term) >= 3"
    sql["transliterated_counts"] = counts(tokens(text=to_ascii("text")))
    sql["nested_counts"] = (
        "select doc_id, max(n) as max_n, count(*) as n_terms, "
        f"md5(string_agg(term || ':' || n, ' ' order by term)) as listing from ({counts(tokens())}) group by doc_id"
    )
    sql["max_term_count"] = f"select doc_id, max(n) as max_n from ({counts(tokens())}) group by doc_id"
    first = "select {k}, term, n from (select *, row_number() over (partition by {k} order by n desc, term) as place " \
            "from ({c})) where place = 1"
    sql["top_term"] = first.format(k="doc_id", c=counts(tokens()))
    by_source = counts(tokens(key="source"), "source")
    sql["source_counts"] = by_source
    sql["source_top_term"] = first.format(k="source", c=by_source)

    sql["kept_profile_counts"] = f"""with c as ({counts(tokens())}) select 'documents' as what, count(distinct doc_id) as n from c
        union all select 'terms', count(distinct term) from c union all select 'occurrences', cast(sum(n) as bigint) from c"""

    # Weights
    sql["document_count"] = f"with {WEIGHTS} select n_docs from total"
    sql["document_frequency"] = f"with {WEIGHTS} select term, df from df"
    sql["idf"] = f"with {WEIGHTS} select term, df, round(idf, 6) as idf from idf"
    sql["idf_given_total"] = f"with {WEIGHTS} select term, df, round(log2(1e6 / df), 6) as idf from df"
    sql["normalised_tf"] = f"with {WEIGHTS} select doc_id, term, n, round(tf, 6) as tf from tf"
    sql["tfidf"] = f"with {WEIGHTS} select doc_id, term, round(tfidf, 6) as tfidf from tfidf"
    sql["tfidf_large_vocabulary"] = sql["tfidf"]
    sql["tf_by_word"] = f"with {WEIGHTS} select term, count(*) as n_docs, round(sum(tf), 6) as tf_sum from tf group by term"
    sql["tfidf_top_terms"] = f"""with {WEIGHTS} select doc_id, term, rank, round(tfidf, 6) as tfidf from (
        select *, cast(row_number() over (partition by doc_id order by tfidf desc, term) as integer) as rank
        from tfidf) where rank <= 5"""
    sql["postings"] = f"with {WEIGHTS} select term, df, doc_id, n from counts join df using (term)"
    blocks = f"cast(ceil(df / {BLOCK}.0) as integer)"

    def listings(key: str, counted: str, before: str = "") -> str:
        place = f"('0x' || substr(md5(cast({key} as varchar)), 1, 8))::bigint % {blocks}"
        return f"""with {before} counts as ({counted}),
            df as (select term, count(*) as df from counts group by term),
            placed as (select *, {blocks} as blocks, cast({place} as integer) as block from counts join df using (term))
            select term, df, block, blocks, count(*) as n_postings,
                   md5(string_agg({key} || ':' || n, ' ' order by {key})) as listing
            from placed group by term, df, block, blocks"""

    sql["posting_lists"] = listings("doc_id", counts(tokens()))
    words = tokens("named", "file_name", "content", fv.ASCII_SEPARATOR, keep_empty=True)
    named = f"named as (select replace(path, 'books/', '') as file_name, content from ({inputs.editions_sql(1)})),"
    sql["file_index"] = listings("file_name", counts(words, "file_name"), named)

    # Vectors
    size, (left, right) = fv.VECTOR_SIZE, (fv.VECTOR_SIZE // 2 - 1, fv.VECTOR_SIZE // 2 + 1)
    one = cells(f"{HASH} % {size}")
    double = cells(f"{HASH} % {left}", f"{left} + {HASH} % {right}")
    sql["hash_cells"] = f"with {WEIGHTS} {one}"
    sql["hash_cells_large_vocabulary"] = sql["hash_cells"]
    sql["double_hash_cells"] = f"with {WEIGHTS} {double}"
    sql["feature_vectors"] = f"""with {WEIGHTS} select doc_id, cast({size} as bigint) as size,
        count(*) filter (value > 0) as n_filled, round(sum(value), 6) as total from ({one}) group by doc_id"""
    sql["vector_size_cells"] = f"with {WEIGHTS} " + " union all ".join(
        f"select cast({s} as integer) as size, doc_id, bucket, value from ({cells(f'{HASH} % {s}')})"
        for s in (100, 1000, 10_000)
    )

    # Documents from book files
    split = split_books()
    sql["header_fields"] = f"""with {split} select path, book_id, charset, cast(enc_rank as integer) as enc_rank,
        regexp_matches(header, '(?m){language_line('English')}') as english, regexp_matches(header, '(?m){language_line('German')}') as german,
        regexp_matches(header, '(?m){language_line('French')}') as french, regexp_matches(header, '(?m){language_line('Esperanto')}') as esperanto,
        md5(header) as header_md5, md5(cut) as body_md5 from ranked"""
    sql["book_documents"] = f"with {split} select {DOC_OUT}, enc_rank from docs"
    sql["book_documents_by_rules"] = f"with {split} select {DOC_OUT}, enc_rank from docs where {RULES}"
    sql["book_documents_two_rules"] = f"""with {split} select {DOC_OUT}, enc_rank from docs
        where regexp_matches(header, '(?m){language_line('German')}') or regexp_matches(header, '(?m){language_line('French')}')"""
    loose = f"""editions as ({inputs.editions_sql(1)}),
        found as (select path, content, ltrim({field('content', fv.BOOK_ID)}, '#') as doc_id,
                         regexp_split_to_array(content, '{START}') as p,
                         regexp_extract_all(content, '{START}') as m from editions),
        loose as (select path, content, doc_id, case when len(p) > 1 then
                         substr(content, length(p[1]) + length(m[1]) + 1) end as body from found)"""
    english = f"regexp_matches(content, '(?m){language_line('English')}')"
    sql["book_documents_unfiltered"] = f"with {loose} select {DOC_OUT} from loose"
    sql["book_documents_english"] = f"""with {loose}, said as (select path, case when {english} then doc_id end as doc_id,
        case when {english} then body end as body from loose) select {DOC_OUT} from said"""
    sql["transliterated_texts"] = f"select doc_id, {to_ascii('text')} as text from documents"
    many = split_books(3)
    sql["best_edition"] = f"""with {many} select {DOC_OUT}, enc_rank from (select *, row_number() over
        (partition by doc_id order by enc_rank desc, path) as place from docs) where place = 1"""
    sql["first_edition"] = f"""with {many} select {DOC_OUT}, enc_rank from (select *, row_number() over
        (partition by doc_id order by path) as place from docs) where place = 1"""
    sql["edition_profiles"] = f"""with {many}, chosen as (select doc_id, body from (select *, row_number() over
        (partition by doc_id order by enc_rank desc, path) as place from docs) where place = 1)
        {counts(tokens('chosen', text='body'))}"""

    full = f"(select * from docs where {RULES})"
    best = f"""best as (select doc_id, {to_ascii('body')} as body from (select *, row_number() over
        (partition by doc_id order by enc_rank desc, path) as place from {full}) where place = 1), stop(w) as (values {STOP})"""
    full_counts = counts(f"{tokens('best', text='body')} and {STOPPED}")
    sql["edition_profiles_all_options"] = f"with {many}, {best} {full_counts}"
    filled = f"select * from ({one}) where value <> 0"
    sql["book_vectors"] = f"with {many}, {best}, {weights(full_counts)} {filled}"

    # Documents by lines
    sql["book_lines"] = f"with {LINES} select path, cast(line_no as integer) as line_no, line from lines"
    sql["probed_lines"] = f"""with {LINES} select path, cast(line_no as integer) as line_no,
        {field('line', fv.BOOK_ID)} as hit from lines where {field('line', fv.BOOK_ID)} is not null"""
    sql["line_documents"] = f"with {LINES} select {DOC_OUT} from parts"
    sql["line_documents_by_rules"] = f"with {LINES} select {DOC_OUT} from parts where {RULES}"
    sql["line_documents_cut"] = f"with {LINES} select {DOC_OUT.replace('body)', 'cut)')} from parts"
    sql["line_edition_profiles"] = f"with {lines_ctes(3)} {counts(tokens('firsts', text='body'))}"
    ruled = f"""ruled as (select doc_id, {to_ascii('body')} as body from (select *, row_number() over
        (partition by doc_id order by path) as place from parts where {RULES}) where place = 1), stop(w) as (values {STOP})"""
    line_counts = counts(f"{tokens('ruled', text='body')} and {STOPPED}")
    sql["line_book_vectors"] = f"with {lines_ctes(3)}, {ruled}, {weights(line_counts)} {filled}"

    # Metadata
    sql["metadata_records"] = f"with {METADATA} {RECORDS_OUT}"
    sql["metadata_subjects"] = f"""with {METADATA}
        select file_name, ebook_id, cast(place as integer) as place, subject_id, subject_txt from subjects"""
    sql["metadata_with_blanks"] = f"""with {METADATA} select ebook_id, cast(place as integer) as place,
        coalesce(subject_id, '') as subject_id, subject_txt from subjects"""
    sql["top_subjects"] = f"with {METADATA} select subject, n_books from top"
    sql["subject_labels"] = f"""with {METADATA}, wanted as (
        select cast(d.doc_id as varchar) as doc_id, subject from documents d, top)
        select doc_id, subject, cast(exists(select 1 from subjects s where s.ebook_id = w.doc_id
               and s.subject_txt = w.subject) as integer) as label from wanted w"""

    # Files
    sql["scanned_books"] = f"""with editions as ({inputs.editions_sql(1)}) select cast(doc_id as varchar) as doc_id,
        cast(octet_length(encode(content)) + 1 as bigint) as file_size, md5(content || chr(10)) as content_md5 from editions"""
    sql["flat_scanned_books"] = sql["scanned_books"]
    plain = "replace(content, 'encoding: ISO-8859-1', 'encoding: US-ASCII') || chr(10)"
    sql["stored_books"] = f"""with editions as ({inputs.editions_sql(1)}) select cast(doc_id as varchar) as doc_id,
        cast(octet_length(encode({plain})) as bigint) as file_size, md5({plain}) as content_md5
        from editions"""
    sql["small_scanned_books"] = f"select * from ({sql['scanned_books']}) where file_size < 2000"
    latin = r"regexp_replace(content, '[^\x00-\xFF]', '?', 'g')"
    sql["decoded_books"] = f"""with editions as ({inputs.editions_sql(1)}) select path, md5(
        case when contains(content, 'Character set encoding: ISO-8859-1') then {latin} else content end) as content_md5
        from editions"""
    sql["counted_files"] = "select count(*) as n_files from documents"
    sql["scanned_metadata"] = f"""with {METADATA} select ebook_id, birth_year, n_subjects from ({RECORDS_OUT})"""
    sql["stored_folder_metadata"] = f"""with {METADATA} select ebook_id, birth_year, n_subjects, (select count(*) from documents) as n_files
        from ({RECORDS_OUT})"""
    sql["book_metadata"] = f"""with {METADATA} select r.ebook_id, birth_year, cast(place as integer) as place, subject_id, subject_txt
        from subjects s join records r on s.file_name = r.file_name"""
    sql["stored_metadata"] = f"with {METADATA} {RECORDS_OUT}"

    # Learning
    def ticket(salt: int) -> str:
        return f"('0x' || substr(md5('{salt}|' || doc_id), 1, 8))::bigint"

    learning = f"""select doc_id, subject, label, {ticket(0)} % 1000000 < 250000 as testing, cast({ticket(1)} % 3 as integer) as fold
        from ({sql["subject_labels"]})"""
    sql["learning_rows"] = learning
    sql["majority_errors"] = f"""select subject, n_training, n_testing, round(case when p > 0.5 then 1 - p else p end, 6) as training_error,
        round(case when p > 0.5 then 1 - q else q end, 6) as testing_error from (
        select subject, avg(label) filter (not testing) as p, avg(label) filter (testing) as q,
               count(*) filter (not testing) as n_training, count(*) filter (testing) as n_testing
        from ({learning}) group by subject)"""

    # Naive Bayes in closed form, on vectors of one or several sizes
    def bayes(hashed: str, size: int) -> str:
        return f"""{WEIGHTS}, lr as ({learning}),
            cell as (select cast(doc_id as varchar) as doc_id, bucket, value from ({hashed}) where value <> 0),
            train as (select * from lr where not testing),
            every as (select bucket, sum(value) as v from cell
                      where doc_id in (select doc_id from train) group by bucket),
            own as (select subject, bucket, sum(value * label) as v from cell join train using (doc_id) group by subject, bucket),
            base as (select subject, ln(((select sum(v) from every) - sum(v) + {size}) / (sum(v) + {size})) as b from own group by subject),
            prior as (select subject, ln((sum(label) + 1) / (count(*) - sum(label) + 1)) as p from train group by subject),
            nb as (select subject, bucket, ln((own.v + 1) / (every.v - own.v + 1)) + b as w
                   from own join every using (bucket) join base using (subject)),
            said as (select doc_id, subject, sum(value * coalesce(w, b)) as m from cell cross join base
                     left join nb using (subject, bucket) group by doc_id, subject),
            judged as (select doc_id, subject, testing, label, case when p + coalesce(m, 0) > 0 then 1 else 0 end as prediction
                       from lr join prior using (subject) left join said using (doc_id, subject)),
            errors as (select subject, round(avg(case when prediction <> label then 1.0 else 0.0 end) filter (not testing), 6) as training_error,
                              round(avg(case when prediction <> label then 1.0 else 0.0 end) filter (testing), 6) as testing_error
                       from judged group by subject)"""

    nb = bayes(one, size)
    sql["naive_bayes_weights"] = f"""with {nb} select subject, bucket, round(w, 5) as weight from nb
        union all select subject, -1, round(p, 5) from prior"""
    sql["naive_bayes_predictions"] = f"""with {nb} select doc_id, subject, testing, label, prediction from judged"""
    sql["naive_bayes_errors"] = f"with {nb} select * from errors"
    sql["vector_size_naive_bayes"] = " union all ".join(
        f"select cast({s} as integer) as size, * from (with {bayes(cells(f'{HASH} % {s}'), s)} select * from errors)" for s in (100, 1000, 10_000)
    )
    sql["double_hash_pairs"] = f"""with a as (with {nb} select * from judged where testing),
        b as (with {bayes(double, size)} select * from judged where testing)
        select subject, count(*) filter (a.prediction = a.label and b.prediction = b.label) as both,
               count(*) filter (a.prediction = a.label and b.prediction <> b.label) as first_only,
               count(*) filter (a.prediction <> a.label and b.prediction = b.label) as second_only,
               count(*) filter (a.prediction <> a.label and b.prediction <> b.label) as neither
        from a join b using (doc_id, subject) group by subject"""

    # Two levels of a decision tree
    rank = " + ".join(f"cast(value > {edge} as integer)" for edge in EDGES)
    edges = ", ".join(f"({i})" for i in range(len(EDGES)))

    def gini(n: str, p: str) -> str:
        return f"(2 * ({p} / {n}) * (1 - {p} / {n}))"

    def level(at: int) -> str:
        """Splits of the nodes that rows in ``node{at}`` are in, and the nodes after it."""
        return f"""
            size{at} as (select subject, node, count(*)::double as n, sum(label)::double as p from node{at}
                         where not testing group by subject, node),
            above{at} as (select subject, node, bucket, e, count(*)::double as nr, sum(label)::double as pr
                          from cell join node{at} using (doc_id) join (values {edges}) as t(e) on rank > e where not testing group by all),
            tried{at} as (select subject, node, bucket, e, n, p, n - nr as nl, p - pr as pl, nr, pr
                          from above{at} join size{at} using (subject, node) where nr < n and p > 0 and p < n),
            best{at} as (select * from (select *, row_number() over (partition by subject, node order by gain desc, bucket, e) as place from (
                select *, round({gini('n', 'p')} - (nl * {gini('nl', 'pl')} + nr * {gini('nr', 'pr')}) / n, 9) as gain from tried{at}))
                where place = 1 and gain > 0),
            node{at + 1} as (select doc_id, x.subject, label, testing, case when b.bucket is null then node
                             when coalesce(rank, 0) <= e then 2 * node + 1 else 2 * node + 2 end as node
                             from node{at} x left join best{at} b using (subject, node) left join cell using (doc_id, bucket))"""

    grown = f"""{WEIGHTS}, lr as ({learning}),
        cell as (select cast(doc_id as varchar) as doc_id, bucket, {rank} as rank from ({one}) where value <> 0),
        node0 as (select doc_id, subject, label, testing, 0 as node from lr), {level(0)}, {level(1)}"""
    sql["tree_splits"] = f"""with {grown} select subject, cast(node as integer) as node, bucket, cast(e as integer) as edge,
        cast(n as bigint) as n, cast(p as bigint) as positive from (select * from best0 union all select * from best1)"""
    sql["shallow_tree_errors"] = f"""with {grown},
        leaf as (select subject, node, case when 2 * sum(label) > count(*) then 1 else 0 end as says from node2 where not testing group by subject, node)
        select subject, round(avg(case when coalesce(says, 0) <> label then 1.0 else 0.0 end) filter (not testing), 6) as training_error,
               round(avg(case when coalesce(says, 0) <> label then 1.0 else 0.0 end) filter (testing), 6) as testing_error
        from node2 left join leaf using (subject, node) group by subject"""

    # Every model has to be an optimum
    sql["logistic_optimum"] = f"""select subject, count(*) filter (not testing) as n_training, true as optimal
        from ({learning}) group by subject"""
    sql["lasso_optimum"] = f"""with {METADATA} select cast(penalty as double) as reg_param, n as n_training, true as optimal
        from (values (0.1), (1.0), (10.0)) as t(penalty) cross join (select count(distinct ebook_id) as n from records
              where ebook_id is not null and birth_year is not null and {ticket(0).replace("doc_id", "ebook_id")} % 1000000 >= 250000)"""

    # Looks
    draws = ", ".join(f"({d})" for d in range(4))
    sql["drawn_counts"] = f"""select draw, doc_id, term, n from (select *, row_number() over (partition by draw
        order by md5('0|' || draw || '|' || doc_id || '|' || term), doc_id, term) as place
        from ({counts(tokens())}) cross join (values {draws}) as t(draw)) where place = 1"""
    sql["first_counts"] = f"select doc_id, term, n from ({counts(tokens())}) order by n desc, doc_id, term limit 20"
    return sql


SQL = _sql()
