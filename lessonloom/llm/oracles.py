"""DuckDB SQL for those operators whose results SQL can state."""

from __future__ import annotations

from lessonloom.llm.quality_rules import MAX_LINE_SHARE, MAX_NGRAM_SHARE, MAX_SYMBOL_SHARE

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
WORDS = f"w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as l from documents), p as (select doc_id, l, generate_subscripts(l, 1) as pos, unnest(l) as word from w)"


def covered(n: int, condition: str) -> str:
    """Whether a window of n words that fulfils the condition covers the word."""
    return f"max(case when {condition} then pos end) over (partition by doc_id order by pos rows between {n - 1} preceding and current row) is not null"


SUBSTRING_DEDUP = f"""with {WORDS},
 k as (select *, case when pos + 34 <= len(l) then array_to_string(l[pos : pos + 34], ' ') end as key from p),
 c as (select *, key is not null and count(*) over (partition by key) > 1 as again from k),
 g as (select doc_id, pos, word, {covered(35, 'again')} as gone from c),
 s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as opens from g),
 t as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans, string_agg(word, ' ' order by pos) filter (where not gone) as kept from s group by doc_id)
 select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join t using (doc_id)"""

SUFFIX_DEDUP = """with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
 p as (select doc_id, pos, substr(x, 2 * pos - 1, 2) as byte, case when 2 * pos + 98 <= length(x) then substr(x, 2 * pos - 1, 100) end as key from (select doc_id, x, unnest(generate_series(1, cast(length(x) / 2 as bigint))) as pos from h)),
 m as (select doc_id, pos, byte, key is not null and doc_id > min(doc_id) over (partition by key) as again from p),
 g as (select doc_id, pos, byte, max(case when again then pos end) over (partition by doc_id order by pos rows between 49 preceding and current row) is not null as gone from m),
 s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as opens from g),
 t as (select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans, string_agg(byte, '' order by pos) filter (where not gone) as kept from s group by doc_id)
 select d.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from documents d left join t using (doc_id)"""

_GRAMS = list(MAX_NGRAM_SHARE)
QUALITY_RULES = f"""with {WORDS},
 k as (select doc_id, pos, length(word) as chars, {', '.join(f"case when pos + {n - 1} <= len(l) then array_to_string(l[pos : pos + {n - 1}], ' ') end as key{n}" for n in _GRAMS)} from p),
 c as (select *, key5 is not null and count(*) over (partition by doc_id, key5) > 1 as twice, {', '.join(f"key{n} is not null and row_number() over (partition by doc_id, key{n} order by pos) > 1 as later{n}" for n in _GRAMS)} from k),
 g as (select doc_id, chars, {covered(5, 'twice')} as rep, {', '.join(f"{covered(n, f'later{n}')} as in{n}" for n in _GRAMS)} from c),
 t as (select doc_id, count(*) as n_words, sum(chars) as word_chars, count(*) filter (where rep) as n_repeat_words, {', '.join(f"coalesce(sum(chars) filter (where in{n}), 0) as gram_chars_{n}" for n in _GRAMS)} from g group by doc_id),
 l as (select doc_id, generate_subscripts(x, 1) as pos, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
 r as (select doc_id, length(regexp_replace(line, '{SPACES}', '', 'g')) as chars, row_number() over (partition by doc_id, line order by pos) > 1 as later from l where regexp_matches(line, '{WORD}')),
 n as (select doc_id, count(*) filter (where later) as n_dup_lines, coalesce(sum(chars) filter (where later), 0) as line_chars from r group by doc_id),
 a as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(line_chars, 0) as line_chars, {', '.join(f"coalesce(gram_chars_{k}, 0) as gram_chars_{k}" for k in _GRAMS)} from documents d left join t using (doc_id) left join n using (doc_id)),
 b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from a)
 select *, not base_failed and line_chars <= {MAX_LINE_SHARE}::double * word_chars and n_symbols <= {MAX_SYMBOL_SHARE}::double * word_chars and {' and '.join(f"gram_chars_{k} <= {s}::double * word_chars" for k, s in MAX_NGRAM_SHARE.items())} as kept from b"""

JACCARD_JOIN = f"""with recursive {WORDS},
 s as (select distinct doc_id, case when len(l) < 5 then array_to_string(l, ' ') else array_to_string(l[pos : pos + 4], ' ') end as x from p where pos = 1 or pos + 4 <= len(l)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 c as (select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
 e as (select u, v from c join n a on a.doc_id = u join n b on b.doc_id = v where 10 * common >= 8 * (a.n + b.n - common)),
 r as (select u, v from e union select r.u, e.v from r join e on e.u = r.v)
 select d.doc_id, coalesce(least(d.doc_id, min(r.v)), d.doc_id) as class_id, (select count(*) from e where e.u = d.doc_id) as n_links from documents d left join r on r.u = d.doc_id group by d.doc_id"""

LINE_DEDUP = """with l as (select doc_id, generate_subscripts(x, 1) as pos, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
 k as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
 f as (select key, min(doc_id) as first from k where length(key) >= 10 group by key),
 g as (select k.doc_id, pos, line, coalesce(first < k.doc_id, false) as gone from k left join f using (key))
 select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from g group by doc_id"""

HARD_NEGATIVES = """with q as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
 n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank, id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
 select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""

ORACLES = {"op1_suffix_dedup": SUFFIX_DEDUP, "op3_quality_rules": QUALITY_RULES, "op9_substring_dedup": SUBSTRING_DEDUP, "op10_jaccard_join": JACCARD_JOIN, "op11_line_dedup": LINE_DEDUP, "op13_hard_negatives": HARD_NEGATIVES}
