"""Plans as Spark printed them (``explain extended``), of a join with an aggregate, a window, and a run union."""

# fmt: off
JOINED = r"""== Parsed Logical Plan ==
'Aggregate ['c_mktsegment], ['c_mktsegment, 'sum('o_totalprice) AS s#13]
+- Join Inner, (o_custkey#1L = c_custkey#7L)
   :- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3]
   :  +- Relation [o_orderkey#0L,o_custkey#1L,o_orderstatus#2,o_totalprice#3,o_orderdate#4,o_orderpriority#5] parquet
   +- Project [c_custkey#7L, c_mktsegment#11]
      +- Relation [c_custkey#7L,c_name#8,c_nationkey#9,c_acctbal#10,c_mktsegment#11] parquet

== Analyzed Logical Plan ==
c_mktsegment: string, s: double
Aggregate [c_mktsegment#11], [c_mktsegment#11, sum(o_totalprice#3) AS s#13]
+- Join Inner, (o_custkey#1L = c_custkey#7L)
   :- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3]
   :  +- Relation [o_orderkey#0L,o_custkey#1L,o_orderstatus#2,o_totalprice#3,o_orderdate#4,o_orderpriority#5] parquet
   +- Project [c_custkey#7L, c_mktsegment#11]
      +- Relation [c_custkey#7L,c_name#8,c_nationkey#9,c_acctbal#10,c_mktsegment#11] parquet

== Optimized Logical Plan ==
Aggregate [c_mktsegment#11], [c_mktsegment#11, sum(o_totalprice#3) AS s#13]
+- Project [o_totalprice#3, c_mktsegment#11]
   +- Join Inner, (o_custkey#1L = c_custkey#7L)
      :- Project [o_custkey#1L, o_totalprice#3]
      :  +- Filter isnotnull(o_custkey#1L)
      :     +- Relation [o_orderkey#0L,o_custkey#1L,o_orderstatus#2,o_totalprice#3,o_orderdate#4,o_orderpriority#5] parquet
      +- Project [c_custkey#7L, c_mktsegment#11]
         +- Filter isnotnull(c_custkey#7L)
            +- Relation [c_custkey#7L,c_name#8,c_nationkey#9,c_acctbal#10,c_mktsegment#11] parquet

== Physical Plan ==
AdaptiveSparkPlan isFinalPlan=false
+- HashAggregate(keys=[c_mktsegment#11], functions=[sum(o_totalprice#3)], output=[c_mktsegment#11, s#13])
   +- Exchange hashpartitioning(c_mktsegment#11, 8), ENSURE_REQUIREMENTS, [plan_id=44]
      +- HashAggregate(keys=[c_mktsegment#11], functions=[partial_sum(o_totalprice#3)], output=[c_mktsegment#11, sum#21])
         +- Project [o_totalprice#3, c_mktsegment#11]
            +- SortMergeJoin [o_custkey#1L], [c_custkey#7L], Inner
               :- Sort [o_custkey#1L ASC NULLS FIRST], false, 0
               :  +- Exchange hashpartitioning(o_custkey#1L, 8), ENSURE_REQUIREMENTS, [plan_id=36]
               :     +- Filter isnotnull(o_custkey#1L)
               :        +- FileScan parquet [o_custkey#1L,o_totalprice#3] Batched: true, DataFilters: [isnotnull(o_custkey#1L)], Format: Parquet, Location: [/t.parquet], PartitionFilters: [], PushedFilters: [IsNotNull(o_custkey)], ReadSchema: struct<o_custkey:bigint,o_totalprice:double>
               +- Sort [c_custkey#7L ASC NULLS FIRST], false, 0
                  +- Exchange hashpartitioning(c_custkey#7L, 8), ENSURE_REQUIREMENTS, [plan_id=37]
                     +- Filter isnotnull(c_custkey#7L)
                        +- FileScan parquet [c_custkey#7L,c_mktsegment#11] Batched: true, DataFilters: [isnotnull(c_custkey#7L)], Format: Parquet, Location: [/t.parquet], PartitionFilters: [], PushedFilters: [IsNotNull(c_custkey)], ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>"""

WINDOWED = r"""== Parsed Logical Plan ==
Repartition 8, true
+- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3, c_custkey#7L, c_mktsegment#11, r#22]
   +- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3, c_custkey#7L, c_mktsegment#11, r#22, r#22]
      +- Window [row_number() windowspecdefinition(c_mktsegment#11, o_totalprice#3 ASC NULLS FIRST, specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())) AS r#22], [c_mktsegment#11], [o_totalprice#3 ASC NULLS FIRST]
         +- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3, c_custkey#7L, c_mktsegment#11]
            +- Join Inner, (o_custkey#1L = c_custkey#7L)
               :- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3]
               :  +- Relation [o_orderkey#0L,o_custkey#1L,o_orderstatus#2,o_totalprice#3,o_orderdate#4,o_orderpriority#5] parquet
               +- ResolvedHint (strategy=broadcast)
                  +- Project [c_custkey#7L, c_mktsegment#11]
                     +- Relation [c_custkey#7L,c_name#8,c_nationkey#9,c_acctbal#10,c_mktsegment#11] parquet

== Analyzed Logical Plan ==
o_orderkey: bigint, o_custkey: bigint, o_totalprice: double, c_custkey: bigint, c_mktsegment: string, r: int
Repartition 8, true
+- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3, c_custkey#7L, c_mktsegment#11, r#22]
   +- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3, c_custkey#7L, c_mktsegment#11, r#22, r#22]
      +- Window [row_number() windowspecdefinition(c_mktsegment#11, o_totalprice#3 ASC NULLS FIRST, specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())) AS r#22], [c_mktsegment#11], [o_totalprice#3 ASC NULLS FIRST]
         +- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3, c_custkey#7L, c_mktsegment#11]
            +- Join Inner, (o_custkey#1L = c_custkey#7L)
               :- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3]
               :  +- Relation [o_orderkey#0L,o_custkey#1L,o_orderstatus#2,o_totalprice#3,o_orderdate#4,o_orderpriority#5] parquet
               +- ResolvedHint (strategy=broadcast)
                  +- Project [c_custkey#7L, c_mktsegment#11]
                     +- Relation [c_custkey#7L,c_name#8,c_nationkey#9,c_acctbal#10,c_mktsegment#11] parquet

== Optimized Logical Plan ==
Repartition 8, true
+- Window [row_number() windowspecdefinition(c_mktsegment#11, o_totalprice#3 ASC NULLS FIRST, specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())) AS r#22], [c_mktsegment#11], [o_totalprice#3 ASC NULLS FIRST]
   +- Join Inner, (o_custkey#1L = c_custkey#7L), rightHint=(strategy=broadcast)
      :- Project [o_orderkey#0L, o_custkey#1L, o_totalprice#3]
      :  +- Filter isnotnull(o_custkey#1L)
      :     +- Relation [o_orderkey#0L,o_custkey#1L,o_orderstatus#2,o_totalprice#3,o_orderdate#4,o_orderpriority#5] parquet
      +- Project [c_custkey#7L, c_mktsegment#11]
         +- Filter isnotnull(c_custkey#7L)
            +- Relation [c_custkey#7L,c_name#8,c_nationkey#9,c_acctbal#10,c_mktsegment#11] parquet

== Physical Plan ==
AdaptiveSparkPlan isFinalPlan=false
+- Exchange RoundRobinPartitioning(8), REPARTITION_BY_NUM, [plan_id=83]
   +- Window [row_number() windowspecdefinition(c_mktsegment#11, o_totalprice#3 ASC NULLS FIRST, specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())) AS r#22], [c_mktsegment#11], [o_totalprice#3 ASC NULLS FIRST]
      +- Sort [c_mktsegment#11 ASC NULLS FIRST, o_totalprice#3 ASC NULLS FIRST], false, 0
         +- Exchange hashpartitioning(c_mktsegment#11, 8), ENSURE_REQUIREMENTS, [plan_id=80]
            +- BroadcastHashJoin [o_custkey#1L], [c_custkey#7L], Inner, BuildRight, false
               :- Filter isnotnull(o_custkey#1L)
               :  +- FileScan parquet [o_orderkey#0L,o_custkey#1L,o_totalprice#3] Batched: true, DataFilters: [isnotnull(o_custkey#1L)], Format: Parquet, Location: [/t.parquet], PartitionFilters: [], PushedFilters: [IsNotNull(o_custkey)], ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>
               +- BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint, false]),false), [plan_id=77]
                  +- Filter isnotnull(c_custkey#7L)
                     +- FileScan parquet [c_custkey#7L,c_mktsegment#11] Batched: true, DataFilters: [isnotnull(c_custkey#7L)], Format: Parquet, Location: [/t.parquet], PartitionFilters: [], PushedFilters: [IsNotNull(c_custkey)], ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>"""

UNITED = r"""== Parsed Logical Plan ==
'Aggregate ['count(*) AS n#29]
+- Union false, false
   :- Range (0, 5, step=1, splits=Some(8))
   +- Range (0, 3, step=1, splits=Some(8))

== Analyzed Logical Plan ==
n: bigint
Aggregate [count(1) AS n#29L]
+- Union false, false
   :- Range (0, 5, step=1, splits=Some(8))
   +- Range (0, 3, step=1, splits=Some(8))

== Optimized Logical Plan ==
Aggregate [count(1) AS n#29L]
+- Union false, false
   :- Project
   :  +- Range (0, 5, step=1, splits=Some(8))
   +- Project
      +- Range (0, 3, step=1, splits=Some(8))

== Physical Plan ==
AdaptiveSparkPlan isFinalPlan=true
+- == Final Plan ==
   ResultQueryStage 1
   +- *(4) HashAggregate(keys=[], functions=[count(1)], output=[n#29L])
      +- ShuffleQueryStage 0
         +- Exchange SinglePartition, ENSURE_REQUIREMENTS, [plan_id=127]
            +- *(3) HashAggregate(keys=[], functions=[partial_count(1)], output=[count#33L])
               +- Union
                  :- *(1) Project
                  :  +- *(1) Range (0, 5, step=1, splits=8)
                  +- *(2) Project
                     +- *(2) Range (0, 3, step=1, splits=8)
+- == Initial Plan ==
   HashAggregate(keys=[], functions=[count(1)], output=[n#29L])
   +- Exchange SinglePartition, ENSURE_REQUIREMENTS, [plan_id=111]
      +- HashAggregate(keys=[], functions=[partial_count(1)], output=[count#33L])
         +- Union
            :- Project
            :  +- Range (0, 5, step=1, splits=8)
            +- Project
               +- Range (0, 3, step=1, splits=8)"""
