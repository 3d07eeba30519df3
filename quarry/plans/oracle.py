"""DuckDB oracle SQL, one statement per registered key."""

from __future__ import annotations

from quarry.plans import sqlparts as S

ORACLE: dict[str, str] = {}


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def with_rec(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


# --- fixture views (FIXTURES.md) --------------------------------------------------------

CHUNK_INDEX = """ci as (select vec_id as chunk_id, concat('M', lpad(cast(label as varchar), 3, '0')) as model_num,
       concat('PS', cast(vec_id % 20 as varchar)) as ps_num, embedding from embeddings)"""

QUESTIONS = """q0 as (select c.conv_id, c.turn, (c.conv_id * 8 + c.turn) % (select count(*) from embeddings) as vec_id,
  concat(case c.conv_id % 4
    when 0 then concat('(M', lpad(cast(c.conv_id % 10 as varchar), 3, '0'), ') PS', cast((c.conv_id * 3 + c.turn) % 20 as varchar), ' ')
    when 1 then concat('M', lpad(cast(c.conv_id % 10 as varchar), 3, '0'), '? ')
    when 2 then concat('PS', cast(c.conv_id % 25 as varchar), ' ') else '' end, c.text) as query
from conversations c where c.role = 'user')"""

ROUTED = f"""qi as (select q0.*, {S.part_num('query')} as ps_num, {S.query_model('query')} as raw_model from q0),
qr0 as (select conv_id, turn, vec_id, query, ps_num,
        case when raw_model = ps_num then 'N/A' else raw_model end as model_num from qi),
qr as (select *, case when model_num <> 'N/A' and ps_num <> 'N/A' then 'both' when model_num <> 'N/A' then 'model'
                      when ps_num <> 'N/A' then 'part' else 'none' end as route from qr0),
qv as (select qr.*, e.embedding as qvec from qr join embeddings e using (vec_id))"""

PAIRS = f"""pairs as (select q.conv_id, q.turn, c.chunk_id, {S.sqdist('q.qvec', 'c.embedding')} as score,
                 (q.model_num = 'N/A' or c.model_num = q.model_num) and (q.ps_num = 'N/A' or c.ps_num = q.ps_num) as pass
          from qv q, ci c)"""

FILTERED = """fr as (select *, cast(row_number() over (partition by conv_id, turn order by score, chunk_id) as integer) as rank
       from pairs where pass),
unmatched as (select conv_id, turn from qv q where not exists (select 1 from fr where fr.conv_id = q.conv_id and fr.turn = q.turn)),
fb as (select p.*, cast(row_number() over (partition by p.conv_id, p.turn order by score, chunk_id) as integer) as rank
       from pairs p join unmatched u using (conv_id, turn))"""

SEARCH_CTES = with_ctes(CHUNK_INDEX, QUESTIONS, ROUTED, PAIRS, FILTERED)

ORACLE["query_model_num"] = with_ctes(QUESTIONS) + f"select conv_id, turn, {S.query_model('query')} as model_num from q0"
ORACLE["query_part_num"] = with_ctes(QUESTIONS) + f"select conv_id, turn, {S.part_num('query')} as ps_num from q0"
ORACLE["resolve_id_clash"] = with_ctes(QUESTIONS, ROUTED) + "select conv_id, turn, model_num, ps_num from qr"
ORACLE["route_query"] = with_ctes(QUESTIONS, ROUTED) + "select conv_id, turn, model_num, ps_num, route from qr"
ORACLE["knn_topk"] = SEARCH_CTES + """select conv_id, turn, chunk_id, score, rank from (
  select conv_id, turn, chunk_id, score,
         cast(row_number() over (partition by conv_id, turn order by score, chunk_id) as integer) as rank from pairs)
where rank <= 25"""
ORACLE["knn_filtered"] = SEARCH_CTES + "select conv_id, turn, chunk_id, score, rank from fr where rank <= 25"
ORACLE["knn_postfilter"] = SEARCH_CTES + """select conv_id, turn, chunk_id, score,
  cast(row_number() over (partition by conv_id, turn order by score, chunk_id) as integer) as rank
from (select *, row_number() over (partition by conv_id, turn order by score, chunk_id) as near from pairs)
where near <= 60000 and pass qualify rank <= 25"""
ORACLE["knn_postfilter_quarter"] = ORACLE["knn_postfilter"].replace("near <= 60000", "near <= (select count(*) // 4 from embeddings)")
ORACLE["knn_with_fallback"] = SEARCH_CTES + "select conv_id, turn, chunk_id, score, rank from fb where rank <= 20"
ORACLE["search"] = SEARCH_CTES + """select conv_id, turn, chunk_id, score, rank, false as fallback from fr where rank <= 25
union all select conv_id, turn, chunk_id, score, rank, true as fallback from fb where rank <= 20"""


# --- HTML → page record -------------------------------------------------------------------

from quarry.functions import html as H  # noqa: E402
from quarry.functions.urls import ORIGIN, SCHEME  # noqa: E402
from quarry.operators.links import EXCLUDED_HREF  # noqa: E402

# The oracle's own lists, not those of the code under test.
TAGS = ["noscript", "script", "head", "header", "footer", "button", "input", "select", "img", "style"]
SEED_TAGS = [t for t in TAGS if t != "header"]
CLEAN = S.strip_inputs(S.strip_elements("html", TAGS))

LINK_CTES = [
    f"cl as (select page_id, url, {CLEAN} as html, {S.extract_title('html')} as title from pages)",
    f"""lk0 as (select page_id, url, regexp_extract_all(regexp_replace(html, {S.lit(S.COMMENT)}, ' ', 'g'), {S.lit(S.HREF)}, 1) as l
        from cl where title is not null)""",
    """lk1 as (select page_id, url, unnest(l) as v, cast(generate_subscripts(l, 1) - 1 as integer) as ord from lk0)""",
    f"""lk as (select page_id, url, ord, {S.unescape("case when v like '\"%' or v like '''%' then substr(v, 2, length(v) - 2) else v end")} as href from lk1)""",
    "edges as (select page_id as src, (page_id * 3 + ord * 17 + 1) % (select count(*) from pages) as dst from lk)",
    """fr(page_id, depth) as (select cast(0 as bigint), 0 union
        select e.dst, fr.depth + 1 from fr join edges e on e.src = fr.page_id where fr.depth < 8)""",
    "frontier as (select page_id, cast(min(depth) as integer) as depth from fr group by page_id)",
]
LINKS = "with recursive " + ",\n".join(LINK_CTES) + "\n"


def resolve_sql(base: str, href: str) -> str:
    no_q = f"regexp_replace({base}, '[?#].*$', '')"
    directory = (f"case when regexp_matches({no_q}, {S.lit(ORIGIN + '$')}) then {no_q} || '/' "
                 f"else regexp_replace({no_q}, '[^/]*$', '') end")
    return f"""case when regexp_matches({href}, {S.lit(SCHEME)}) then {href}
        when starts_with({href}, '//') then regexp_extract({base}, {S.lit(SCHEME)}, 1) || ':' || {href}
        when starts_with({href}, '/') then regexp_extract({base}, {S.lit(ORIGIN)}, 1) || {href}
        when starts_with({href}, '?') then {no_q} || {href}
        when starts_with({href}, '#') then regexp_replace({base}, '#.*$', '') || {href}
        when {href} = '' then {base}
        else ({directory}) || {href} end"""


def canonical_sql(u: str) -> str:
    nf = f"regexp_replace({u}, '#.*$', '')"
    args = f"list_filter(string_split(regexp_extract({nf}, '\\?(.*)$', 1), '&'), lambda a: a <> '')"
    path = f"regexp_extract({nf}, '^([^?]*)', 1)"
    return f"case when len({args}) > 0 then {path} || '?' || array_to_string(list_sort({args}), '&') else {path} end"


RESOLVED = f"rl as (select page_id, url, ord, href, {resolve_sql('url', 'href')} as abs_url from lk)"
SITE = (f"sl as (select * from rl where starts_with(abs_url, regexp_extract(url, {S.lit(ORIGIN)}, 1) || '/') "
        f"and href <> {S.lit(EXCLUDED_HREF)})")
LINKS_R = "with recursive " + ",\n".join(LINK_CTES + [RESOLVED, SITE]) + "\n"

PAGE_TEXT = S.page_text("html", TAGS)
SHOP = """shop as (select page_id,
  case when page_id % 3 = 0 then regexp_extract(url, '^[a-z]+://[^/]*') || '/PS1175' || page_id || '-Seal.htm' else url end as url,
  case when page_id % 5 = 4 then regexp_replace(h, '(?is)<title>.*?</title>', '', 'g') else h end as html
from (select page_id, url, html || '<header>Shop header</header><select name="s"><option>one choice</option></select>'
  || '<input type="text" name="q"><img src="a.png"/><button>Buy now</button><noscript>no script here</noscript><p>after the form</p> '
  || 'Your coupon for has been applied and will be reflected when you check out! '
  || '<a href="/ShoppingCart.aspx">cart</a> <a href="https://elsewhere.example/x.htm">off the site</a> '
  || '<a href="/page-' || page_id || '.htm">next</a>' as h from pages))"""


def of_shop(sql: str) -> str:
    """The statement over the shop pages in place of the pages."""
    sql = sql.replace("from pages", "from shop")
    if sql.startswith("with recursive "):
        return "with recursive " + SHOP + ",\n" + sql[len("with recursive "):]
    return "with " + SHOP + "\n" + sql


ORACLE["strip_elements"] = f"select page_id, {S.strip_elements('html', TAGS)} as html from pages"
ORACLE["strip_elements_seed"] = LINKS + "," + SHOP + f""" select page_id, depth,
  case when depth = 0 then {S.strip_elements('html', SEED_TAGS)} else {S.strip_elements('html', TAGS)} end as html
from shop left join frontier using (page_id)"""
ORACLE["strip_inputs"] = of_shop(f"select page_id, {S.strip_inputs('html')} as html from pages")
ORACLE["html_to_text"] = f"select page_id, {S.html_to_text(CLEAN)} as text from pages"
ORACLE["collapse_whitespace"] = f"select page_id, {S.collapse(S.html_to_text(CLEAN))} as text from pages"
ORACLE["drop_boilerplate"] = of_shop(f"select page_id, {PAGE_TEXT} as text from pages")
ORACLE["extract_title"] = f"select page_id, {S.extract_title('html')} as title from pages"
ORACLE["drop_untitled"] = of_shop(f"select * from (select page_id, url, {S.extract_title('html')} as title from pages) where title is not null")
ORACLE["title_model_num"] = f"""select page_id, title, {S.title_model('title')} as model_num
from (select page_id, {S.extract_title('html')} as title from pages) where title is not null"""
ORACLE["url_part_num"] = of_shop(f"select page_id, url, {S.part_num('url')} as ps_num from pages")

RECORDS_CTE = f"""rec as (select * from (select page_id, {S.page_text('html', TAGS, SEED_TAGS, 'depth')} as text, url, depth,
    {S.extract_title('html')} as title from pages left join frontier using (page_id)) where title is not null),
records as (select page_id, text, url, depth, title, {S.title_model('title')} as model_num, {S.part_num('url')} as ps_num from rec)"""
ORACLE["page_records"] = LINKS + "," + RECORDS_CTE + "\nselect * from records"

ORACLE["extract_links"] = LINKS + "select page_id, ord, href from lk"
ORACLE["resolve_links"] = LINKS_R + "select page_id, ord, href, abs_url from rl"
ORACLE["filter_links"] = of_shop(LINKS_R + "select page_id, ord, abs_url from sl")
ORACLE["dedupe_urls"] = LINKS_R + f"""select distinct {canonical_sql('abs_url')} as url from sl
where {canonical_sql('abs_url')} not in (select {canonical_sql('url')} from pages)"""
ORACLE["crawl_frontier"] = LINKS + "select page_id, depth from frontier"


# --- chunking, embedding, index -------------------------------------------------------------

from quarry.functions.text import WS  # noqa: E402


def chunk_ctes(p: str, src: str, key: str, text: str, size: int, overlap: int, sep: str) -> list[str]:
    """Chunk rule as a recursive CTE: ``{p}out(doc_id, chunk_idx, text)``.

    ``Q[i]`` are prefix sums of (word length + separator length); the two
    binary searches of the rule are ASOF joins over ``Q``.
    """
    d = len(sep)
    sep_sql = "' '" if sep == " " else "chr(10) || chr(10)"
    return [
        f"{p}w1 as (select {key} as doc_id, list_filter(string_split({text}, {sep_sql}), lambda x: x <> '') as ws from {src})",
        f"{p}n as (select doc_id, len(ws) as n from {p}w1 where len(ws) > 0)",
        f"{p}w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from {p}w1)",
        f"""{p}qq as (select doc_id, i + 1 as i, sum(length(word) + {d}) over (partition by doc_id order by i
                 rows between unbounded preceding and current row) as q from {p}w
            union all select doc_id, 0, 0 from {p}n)""",
        # emax(s) = (number of Q ≤ Q[s] + size + d) − 1: points sort before equal thresholds
        f"""{p}em as (select doc_id, s, emax from (
              select doc_id, s, kind, sum(1 - kind) over (partition by doc_id order by v, kind
                     rows between unbounded preceding and current row) - 1 as emax
              from (select doc_id, q as v, 0 as kind, null as s from {p}qq
                    union all select doc_id, q + {size + d}, 1, i from {p}qq)) where kind = 1)""",
        f"""{p}nd as (select qq.doc_id, qq.i as e, greatest(qq.q - {d} - {overlap}, qq.q + length(w.word) - {size}) as need
            from {p}qq qq join {p}w w on w.doc_id = qq.doc_id and w.i = qq.i)""",
        # nxt(e) = number of Q < need: thresholds sort before equal points
        f"""{p}nx as (select doc_id, e, nxt from (
              select doc_id, e, kind, sum(kind) over (partition by doc_id order by v, kind
                     rows between unbounded preceding and current row) as nxt
              from (select doc_id, q as v, 1 as kind, null as e from {p}qq
                    union all select doc_id, need, 0, e from {p}nd)) where kind = 0)""",
        f"""{p}ch(doc_id, s, e, n) as (
            select n.doc_id, 0, greatest(1, em.emax), n.n from {p}n n join {p}em em on em.doc_id = n.doc_id and em.s = 0
            union all
            select c.doc_id, c.s2, greatest(c.e + 1, em.emax), c.n
            from (select ch.doc_id, ch.e, ch.n, greatest(ch.s, least(coalesce(nx.nxt, ch.e), ch.e)) as s2
                  from {p}ch ch join {p}nx nx on nx.doc_id = ch.doc_id and nx.e = ch.e where ch.e < ch.n) c
            join {p}em em on em.doc_id = c.doc_id and em.s = c.s2)""",
        f"""{p}ct as (select ch.doc_id, ch.s, {S.py_strip(f"array_to_string(w1.ws[ch.s + 1 : ch.e], {sep_sql})")} as text
            from {p}ch ch join {p}w1 w1 using (doc_id))""",
        f"""{p}out as (select doc_id, cast(row_number() over (partition by doc_id order by s) - 1 as integer) as chunk_idx, text
            from {p}ct where text <> '')""",
    ]


def embed_ctes(p: str, src: str, keys: list[str], text: str, dim: int = 64) -> list[str]:
    """Hash embedding as sparse rows ``{p}vals(keys…, bucket, value)`` (value rounded through float32)."""
    k = ", ".join(keys)
    words = f"list_filter(regexp_split_to_array(lower(replace({text}, chr(10), ' ')), {S.lit(WS + '+')}), lambda w: w <> '')"
    return [
        f"{p}ew as (select {k}, unnest({words}) as w from {src})",
        f"{p}ec as (select {k}, cast('0x' || substr(md5(w), 1, 8) as bigint) % {dim} as bucket, count(*) as c from {p}ew group by all)",
        f"{p}en as (select {k}, sqrt(sum(c * c)) as nrm from {p}ec group by all)",
        f"""{p}vals as (select {k}, cast(bucket as integer) as bucket, cast(cast(c / nrm as float) as double) as value
            from {p}ec join {p}en using ({k}))""",
    ]


def fingerprint_ctes(p: str, vals: str, keys: list[str]) -> list[str]:
    k = ", ".join(keys)
    return [f"""{p}fp as (select {k}, cast(count(*) as integer) as emb_nnz, round(sum(value * (bucket + 1)), 6) as emb_sig
               from {vals} group by all)"""]


PARAGRAPHS = "para as (select doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) as text from documents)"


def _docs_chunks(sep=" ", size=1000, overlap=200):
    return [PARAGRAPHS] + chunk_ctes("c_", "documents" if sep == " " else "para", "doc_id", "text", size, overlap, sep)


ORACLE["chunk_words"] = with_rec(*_docs_chunks()) + "select doc_id, chunk_idx, text from c_out"
ORACLE["chunk_paragraphs"] = with_rec(*_docs_chunks("\n\n")) + "select doc_id, chunk_idx, text from c_out"
ORACLE["chunk_paragraphs_no_overlap"] = with_rec(*_docs_chunks("\n\n", 1000, 0)) + "select doc_id, chunk_idx, text from c_out"
ORACLE["embed_documents"] = with_ctes(*embed_ctes("e_", "documents", ["doc_id"], "text")) + "select doc_id, bucket, value from e_vals"
ORACLE["embed_queries"] = with_ctes(QUESTIONS, *embed_ctes("e_", "q0", ["conv_id", "turn"], "query")) + \
    "select conv_id, turn, bucket, value from e_vals"

DOCS_CTE = f"""docs as (select page_id as doc_id, 'text: ' || {S.py_strip('coalesce(text, \'\')')} || chr(10) || 'url: ' ||
    {S.py_strip('coalesce(url, \'\')')} as page_content, url, depth, title, model_num, ps_num from records)"""


def index_ctes(p: str, size=1000, overlap=200) -> list[str]:
    return chunk_ctes(p, "docs", "doc_id", "page_content", size, overlap, " ") + [
        f"""{p}ix as (select (o.doc_id << 20) + o.chunk_idx as chunk_id, o.doc_id, d.url, o.chunk_idx, o.text, d.depth,
               d.title, d.model_num, d.ps_num from {p}out o join docs d using (doc_id))""",
    ] + embed_ctes(p + "e", f"{p}ix", ["chunk_id"], "text") + fingerprint_ctes(p, f"{p}evals", ["chunk_id"]) + [
        f"""{p}view as (select i.*, coalesce(f.emb_nnz, 0) as emb_nnz, coalesce(f.emb_sig, 0.0) as emb_sig
               from {p}ix i left join {p}fp f using (chunk_id))"""]


PAGE_DOCS = LINKS + "," + RECORDS_CTE + ",\n" + DOCS_CTE + ",\n"
ORACLE["compose_document"] = PAGE_DOCS.rstrip().rstrip(",") + "\nselect * from docs"
ORACLE["build_index"] = PAGE_DOCS + ",\n".join(index_ctes("x_")) + "\nselect * from x_view"
ORACLE["append_index"] = ORACLE["build_index"]
ORACLE["load_index"] = PAGE_DOCS + ",\n".join(index_ctes("x_")[:-5]) + \
    "\nselect (doc_id << 20) + chunk_idx as chunk_id, url, chunk_idx, 64 as dim from x_ix"
ORACLE["upsert_index"] = PAGE_DOCS + ",\n".join(index_ctes("n_") + index_ctes("o_", 500, 100)) + """
select * from n_view where depth >= 3 union all
select * from o_view o where not exists (select 1 from n_view n where n.url = o.url and n.depth >= 3)"""

ORACLE["append_page_csv"] = LINKS + "," + RECORDS_CTE + "\nselect text, url, depth, title, model_num, ps_num from records"
ORACLE["scan_page_csv"] = ORACLE["append_page_csv"]
ORACLE["append_pages"] = ORACLE["append_page_csv"]
ORACLE["scan_pages"] = ORACLE["append_page_csv"] + " where depth <= 3"
ORACLE["scan_text_url_csv"] = LINKS + "," + RECORDS_CTE + "\nselect text, url, true as from_file from records"
ORACLE["map_crawl_items"] = LINKS + "," + RECORDS_CTE + "\nselect text as page_content, url as source from records"


# --- retrieval over the page index and context packing -------------------------------------

from quarry.operators import context as CX  # noqa: E402


def tokens_sql(x: str) -> str:
    return f"cast(len({S.split_ws(x)}) as integer)"


def fmt4_sql(x: str) -> str:
    n = f"cast(round({x} * 10000) as bigint)"
    return f"(cast({n} // 10000 as varchar) || '.' || lpad(cast({n} % 10000 as varchar), 4, '0'))"


PIPE_CTES = [
    f"""pq0 as (select q0.*, {S.part_num('query')} as ps_num, {S.query_model('query')} as raw_model from q0)""",
    """pq1 as (select conv_id, turn, query, ps_num, case when raw_model = ps_num then 'N/A' else raw_model end as model_num from pq0)""",
    """pq as (select *, case when model_num <> 'N/A' and ps_num <> 'N/A' then 'both' when model_num <> 'N/A' then 'model'
                        when ps_num <> 'N/A' then 'part' else 'none' end as route from pq1)""",
    *embed_ctes("qe_", "q0", ["conv_id", "turn"], "query"),
    "qn as (select conv_id, turn, sum(value * value) as n2 from qe_vals group by all)",
    "xn as (select chunk_id, sum(value * value) as n2 from x_evals group by all)",
    """dots as (select q.conv_id, q.turn, x.chunk_id, sum(q.value * x.value) as dot
             from qe_vals q join x_evals x using (bucket) group by all)""",
    """pp as (select q.conv_id, q.turn, c.chunk_id,
             round(greatest(coalesce(qn.n2, 0) + coalesce(xn.n2, 0) - 2 * coalesce(d.dot, 0), 0), 9) as score,
             (q.model_num = 'N/A' or c.model_num = q.model_num) and (q.ps_num = 'N/A' or c.ps_num = q.ps_num) as pass
           from pq q cross join x_ix c
           left join qn on qn.conv_id = q.conv_id and qn.turn = q.turn
           left join xn on xn.chunk_id = c.chunk_id
           left join dots d on d.conv_id = q.conv_id and d.turn = q.turn and d.chunk_id = c.chunk_id)""",
    """pfr as (select *, cast(row_number() over (partition by conv_id, turn order by score, chunk_id) as integer) as rank
            from pp where pass)""",
    """pun as (select conv_id, turn from pq q where not exists (select 1 from pfr where pfr.conv_id = q.conv_id and pfr.turn = q.turn))""",
    """pfb as (select p.*, cast(row_number() over (partition by p.conv_id, p.turn order by score, chunk_id) as integer) as rank
            from pp p join pun u using (conv_id, turn))""",
    """hits as (select conv_id, turn, rank, chunk_id, score, false as fallback from pfr where rank <= 25
             union all select conv_id, turn, rank, chunk_id, score, true from pfb where rank <= 20)""",
]


def packing_ctes(intro: str, p: str = "") -> list[str]:
    art = (f"""'\n\nWebpage:\n\"\"\"\n' || x.text || '\nSource: ' || x.url || '\nScore: ' || {fmt4_sql('h.score')} || '\n\"\"\"'""")
    prior = """'\n\nEarlier webpage:\n\"\"\"\n' || x.text || '\nSource: ' || x.url || '\n\"\"\"'"""
    return [
        f"{p}art as (select h.conv_id, h.turn, h.rank, h.chunk_id, {art} as piece from hits h join x_ix x using (chunk_id))",
        f"{p}arts as (select *, {tokens_sql('piece')} as tokens from {p}art)",
        f"""{p}base as (select conv_id, turn, {tokens_sql(S.lit(intro) + " || chr(10) || chr(10) || 'Question: ' || query")} as b from pq)""",
        f"""{p}docs as (select a.conv_id, a.turn, a.rank, a.chunk_id, a.tokens, a.piece from (
              select a.*, coalesce(sum(tokens) over (partition by conv_id, turn order by rank
                     rows between unbounded preceding and 1 preceding), 0) as before from {p}arts a) a
              join {p}base b using (conv_id, turn)
            where a.rank = 1 or b.b + a.before <= {CX.TOKEN_BUDGET - 2048})""",
        f"""{p}ph0 as (select h.conv_id, h.turn, h.rank, h.chunk_id, {prior} as piece from hits h join x_ix x using (chunk_id) where h.rank <= 2)""",
        f"{p}ph as (select *, {tokens_sql('piece')} as tokens from {p}ph0)",
        f"""{p}pt as (select q.conv_id, q.turn, coalesce(sum(ph.tokens), 0) as t from pq q left join {p}ph ph using (conv_id, turn) group by all)""",
        f"{p}pa as (select *, sum(t) over (partition by conv_id order by turn) as a from {p}pt)",
        f"""{p}prior as (select h.conv_id, q.turn as turn, h.turn as src_turn, h.rank, h.chunk_id, h.tokens, h.piece from (
              select ph.*, coalesce(sum(tokens) over (partition by conv_id, turn order by rank
                     rows between unbounded preceding and 1 preceding), 0) as r, pa.a
              from {p}ph ph join {p}pa pa using (conv_id, turn)) h
            join {p}pa q on q.conv_id = h.conv_id and h.turn < q.turn
            where h.rank = 1 or (q.a - q.t) - h.a + h.r <= {CX.PRIOR_HITS_BUDGET})""",
        f"""{p}qa as (select conv_id, turn, concat('Question: ', text, chr(10), chr(10), 'Answer: ', nxt) as qa
             from (select *, lead(text) over (partition by conv_id order by turn) as nxt,
                          lead(role) over (partition by conv_id order by turn) as nr from conversations) z
             where role = 'user' and nr = 'assistant')""",
        f"""{p}an as (select qa.conv_id, qa.turn, {tokens_sql('qa.qa')} as tokens,
               '\n\nEarlier question and answer:\n\"\"\"\n' || qa.qa || '\n\"\"\"' as piece
             from {p}qa qa where exists (select 1 from hits h where h.conv_id = qa.conv_id and h.turn = qa.turn))""",
        f"""{p}atot as (select q.conv_id, q.turn, coalesce(sum(an.tokens), 0) as t from pq q left join {p}an an using (conv_id, turn) group by all)""",
        f"{p}ac as (select *, sum(t) over (partition by conv_id order by turn) as c from {p}atot)",
        f"""{p}answers as (select an.conv_id, q.turn as turn, an.turn as src_turn, an.tokens, an.piece
             from {p}an an join {p}ac h using (conv_id, turn) join {p}ac q on q.conv_id = an.conv_id and an.turn < q.turn
             where (q.c - q.t) - h.c <= {CX.PRIOR_ANSWERS_BUDGET})""",
        f"""{p}pieces as (select conv_id, turn, 0 as s, 0 as a, 0 as b, {S.lit(intro)} as p from pq
                   where exists (select 1 from {p}docs d where d.conv_id = pq.conv_id and d.turn = pq.turn)
             union all select conv_id, turn, 1, rank, 0, piece from {p}docs
             union all select conv_id, turn, 2, -src_turn, rank, piece from {p}prior
             union all select conv_id, turn, 3, -src_turn, 0, piece from {p}answers
             union all select conv_id, turn, 4, 0, 0, chr(10) || chr(10) || 'Question: ' || query from pq
                   where exists (select 1 from {p}docs d where d.conv_id = pq.conv_id and d.turn = pq.turn))""",
        f"""{p}prompts as (select q.conv_id, q.turn, q.query, x.prompt, {tokens_sql('x.prompt')} as tokens_used from pq q
             join (select conv_id, turn, string_agg(p, '' order by s, a, b) as prompt from {p}pieces group by all) x
             using (conv_id, turn))""",
    ]


PIPE = PAGE_DOCS + ",\n".join(index_ctes("x_")) + ",\n" + QUESTIONS + ",\n" + ",\n".join(PIPE_CTES) + ",\n"
PACK = PIPE + ",\n".join(packing_ctes(CX.INTRO_TEXT, "k_")) + "\n"

ORACLE["append_search_history"] = PIPE.rstrip().rstrip(",") + "\nselect * from hits"
ORACLE["count_tokens"] = f"select conv_id, turn, {tokens_sql('text')} as tokens from conversations"
ORACLE["pack_documents"] = PACK + "select conv_id, turn, rank, chunk_id, tokens from k_docs"
ORACLE["pack_prior_hits"] = PACK + "select conv_id, turn, src_turn, rank, chunk_id, tokens from k_prior"
ORACLE["pack_prior_answers"] = PACK + "select conv_id, turn, src_turn, tokens from k_answers"
ORACLE["build_prompt"] = PACK + "select * from k_prompts"
ORACLE["no_hit_answer"] = PIPE.rstrip().rstrip(",") + """
select q.conv_id, q.turn, h.conv_id is not null as has_hits,
       case when h.conv_id is null then 'I could not find a direct answer.' end as answer
from pq q left join (select distinct conv_id, turn from hits) h using (conv_id, turn)"""
ORACLE["style_variant"] = (PIPE + ",\n".join(packing_ctes(CX.INTRO_TEXT, "t_") + packing_ctes(CX.INTRO_VOICE, "v_"))
                           + "\n" + f"""select conv_id, turn, 'text' as channel, {S.lit(CX.SYSTEM_TEXT)} as system, prompt as "user" from t_prompts
union all select conv_id, turn, 'voice', {S.lit(CX.SYSTEM_VOICE)}, prompt from v_prompts""")
ORACLE["append_answer_history"] = """select conv_id, turn, concat('Question: ', text, chr(10), chr(10), 'Answer: ', nxt) as qa
from (select *, lead(text) over (partition by conv_id order by turn) as nxt,
             lead(role) over (partition by conv_id order by turn) as nr from conversations) z
where role = 'user' and nr = 'assistant'"""


# --- stage timings ---------------------------------------------------------------------------

TIMING = """tm as (select user_id as conv_id, event_id as turn, event_type as stage, value as seconds
        from events where value is not null)"""
ORACLE["stage_totals"] = with_ctes(TIMING) + """select stage, round(sum(seconds), 6) as seconds,
  (select count(*) from (select distinct conv_id, turn from tm)) as runs from tm group by stage"""
ORACLE["stage_averages"] = with_ctes(TIMING) + """select stage, round(seconds / runs, 6) as avg_seconds from (
  select stage, round(sum(seconds), 6) as seconds, (select count(*) from (select distinct conv_id, turn from tm)) as runs
  from tm group by stage) where runs > 0"""
ORACLE["last_run_stats"] = with_ctes(TIMING) + """select conv_id, stage, arg_max(seconds, turn) as seconds, max(turn) as turn
from tm group by conv_id, stage"""


# --- streaming forms -------------------------------------------------------------------------

ORACLE["stream_ingest"] = ORACLE["build_index"]
ORACLE["stream_context"] = PACK + """select conv_id, turn, 'hit' as section, src_turn, rank, chunk_id, tokens from k_prior
union all select conv_id, turn, 'answer', src_turn, null, null, tokens from k_answers"""
ORACLE["stream_context_timed"] = ORACLE["stream_context"]
