"""Queries on programs of the region language: effects, verdicts, what constraints imply."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.language import check, parse
from tessera.registry import query

#: A ledger of accounts split in two, with one task for each thing that a checker should notice.
LEDGER = """
type account = < int, int >   /* balance, limit */
type entries<re,ra> = < account@ra, < int, entries<re,ra>@re > >
type half<ra> = rr[rh] account@rh where rh <= ra

task deposit ( a: account, amount: int ) : account = < a.1 + amount, a.2 >

task post[re,ra] ( e: entries<re,ra>@re ), reads(re), reduces(deposit, ra) : int =
    if isnull(e) then 0 else
    let v : entries<re,ra> = read(e) in
    let _ : account@ra = reduce(deposit, v.1, v.2.1) in
    1 + post[re,ra](v.2.2)

task split[ra] ( a: account@ra, limit: int ), rdwrs(ra) : account@ra =
    partition ra using color(newcolor ra, a, if read(a).1 < limit then 1 else 2) as low, high in
    let l : account@low = downregion(a, low) in
    let p : half<ra> = pack l as half<ra>[low] in
    unpack p as q : half<ra>[rq] in
    let _ : account@rq = write(q, < 0, limit >) in
    upregion(q, ra)

task peek[ra] ( a: account@ra ), writes(ra), atomic(ra) : int = read(a).1

task stray[ra,rb] ( a: account@ra ), reads(ra), reads(rb) : account@rb = upregion(a, rb)

task outside[re,ra] ( e: entries<re,ra>@re ), reads(re) : int = post[re,ra](e)
"""


@query("""SELECT * FROM (VALUES ('outside','reads','','re'),('peek','atomic','','ra'),('peek','writes','','ra'),('post','reads','','re'),('post','reduces','deposit','ra'),
('split','reads','','ra'),('split','writes','','ra'),('stray','reads','','ra'),('stray','reads','','rb')) AS e(task, effect, function, region)""")
def language_effects(t, spark):
    return parse(LEDGER).effects(spark)


@query("""SELECT * FROM (VALUES ('deposit','ok','ok'),('post','ok','ok'),('split','write privilege','ok'),('peek','read privilege','read privilege'),
('stray','ok','constraint'),('outside','ok','privilege of a call')) AS v(task, plain, strict)""")
def language_verdicts(t, spark):
    """Plain checking wants each region of a pointer among those that the task names; strict checking also takes those within them."""
    p = parse(LEDGER)
    plain, strict = check(p), check(p, strict=True)
    rows = [(n, *(e.kind if e else "ok" for e in (plain[n], strict[n]))) for n in p.tasks]
    return spark.createDataFrame(rows, "task string, plain string, strict string")


WITHIN_SQL = """(SELECT 'nation ' || n_nationkey AS src, 'region ' || n_regionkey AS dst FROM nation UNION SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier)"""


@query(f"WITH RECURSIVE e AS {WITHIN_SQL}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def constraint_closure(t, spark):
    """All that follows from a <= b: suppliers within nations within regions."""

    def node(kind, key):
        return F.concat(F.lit(kind + " "), F.col(key).cast("string"))

    within = t("nation").select(node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst"))
    return graph.reach(within.union(t("supplier").select(node("supplier", "s_suppkey"), node("nation", "s_nationkey"))))
