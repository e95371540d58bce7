"""The same graphs and their ranks in SQL."""

RAW = """select s, d from (
  select l_partkey*3 as s, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)*3 as d from lineitem
  union all select l_partkey*3, l_suppkey*3+1 from lineitem
  union all select o_custkey*3+2, l_partkey*3 from orders join lineitem on o_orderkey = l_orderkey
) where d is not null"""
SEQ = "select s, d from (select l_partkey s, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) d from lineitem) where d is not null"


def graph_sql(raw: str = RAW) -> str:
    return f"""with recursive raw as ({raw}), e as materialized (select distinct s, d from raw), n as (select s id from e union select d from e),
v as materialized (select n.id, coalesce(o.c, 0)::bigint od, coalesce(i.c, 0)::bigint idg, count(*) over ()::double nn,
  row_number() over (order by n.id) - 1 node from n left join (select s id, count(*) c from e group by 1) o using (id)
  left join (select d id, count(*) c from e group by 1) i using (id))"""


def ranks_sql(iters: int = 100, damping: float = 0.85, raw: str = RAW, stop: str = "l1 < 1e-6") -> str:
    """pr(it, id, r), err(it, l1) and stop(it)."""
    return graph_sql(raw) + f""", pr(it, id, r) as (select 0, id, 1.0::double/nn from v union all
  select x.it+1, v.id, (1-{damping})::double/v.nn + {damping}::double*x.dang/v.nn + {damping}::double*coalesce(y.sm, 0)
  from v cross join (select max(p.it) it, coalesce(sum(p.r) filter (w.od=0), 0) dang from pr p join v w using (id)) x
  left join (select e.d id, sum(p.r/w.od) sm from pr p join v w using (id) join e on e.s=p.id group by 1) y on y.id=v.id where x.it < {iters}),
err as (select b.it, sum(abs(b.r-a.r)) l1 from pr a join pr b on b.id=a.id and b.it=a.it+1 group by 1),
stop as (select coalesce(min(it) filter ({stop}), max(it)) it from err)"""
