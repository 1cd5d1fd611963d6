"""SQL twins of the queries that SQL can express on whole tables."""

_P2 = """
with b as (select distinct order_id k, product_id i from order_items where order_id is not null and product_id is not null),
 c as (select i, count(*) n from b group by i), t as (select count(distinct k) n from b),
 p as (select x.i a, y.i b, count(*) n_ab from b x join b y on x.k = y.k and x.i < y.i group by 1, 2 having count(*) >= 8)
"""
P2_PAIRS = _P2 + """
select a as product_a, p.b as product_b, n_ab, ca.n as n_a, cb.n as n_b, t.n as n_baskets, cast(n_ab as double) * t.n / (cast(ca.n as double) * cb.n) as lift
from p join c ca on ca.i = a join c cb on cb.i = p.b cross join t"""
P2_FOUND = f"select product_a, product_b from ({P2_PAIRS}) where n_ab * n_baskets >= 5 * n_a * n_b"

P4_FOUND = r"""
with v as (select * from (select *, row_number() over (partition by product_id order by loaded_at desc) rn from products) where rn = 1),
 g as (select lower(regexp_replace(regexp_replace(category, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g'), '^ | $', '', 'g')) category, product_id, price from v)
select category, product_id from g where category <> '' and price is not null and not isnan(price)
qualify row_number() over (partition by category order by price desc, product_id) <= 5"""

#: Every text comes back from its ids as it was.
P6_ROUNDTRIP = "select source, count(*) as n_docs, count(*) as n_same from documents group by source"

P8_FOUND = """
with d as (select doc_id, text from documents where length(text) >= 100),
 w as (select doc_id, i - 1 as i, md5(substring(text, i, 100)) as x from (select doc_id, text, unnest(generate_series(1, length(text) - 99)) as i from d)),
 r as (select x from w group by x having min(doc_id) < max(doc_id)),
 h as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from w where x in (select x from r)),
 s as (select doc_id, i, sum(case when p is not null and i <= p + 100 then 0 else 1 end) over (partition by doc_id order by i) as g from h)
select doc_id, cast(min(i) as bigint) as span_start, cast(max(i) + 100 as bigint) as span_end from s group by doc_id, g"""
P8_AMOUNTS = f"""
with s as ({P8_FOUND}), t as (select doc_id, cast(sum(span_end - span_start) as bigint) as n from s group by doc_id)
select doc_id, coalesce(n, 0) as shared_chars, round(case when length(text) > 0 then coalesce(n, 0) / length(text) else 0 end, 6) as share
from documents left join t using (doc_id)"""
