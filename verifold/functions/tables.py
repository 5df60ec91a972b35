"""Table functions for SQL: what a graph and the states know of a row, called by LATERAL from any query."""

from __future__ import annotations

from pyspark.sql import DataFrame


def register_graph(edges: DataFrame, max_hops: int = 3, prefix: str = "") -> None:
    """neighbors_of(node) and reached_from(node) over edges (source_id, target_id, relation_type, confidence).

    neighbors_of gives (neighbor, direction, relation_type, confidence), an edge from a node to itself once.
    reached_from gives (node, hops, confidence) of what outgoing edges reach in at most max_hops steps: the fewest hops
    and the best product of confidences, a node not reaching itself. Their bodies are SQL, so that a lateral call is an
    equi-join with the edges and no row is asked for by itself. The edges become the view <prefix>graph_edges.
    """
    spark = edges.sparkSession
    edges.createOrReplaceTempView(f"{prefix}graph_edges")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}neighbors_of(asked STRING)
        RETURNS TABLE (neighbor STRING, direction STRING, relation_type STRING, confidence DOUBLE)
        RETURN SELECT e.neighbor, e.direction, e.relation_type, e.confidence FROM (
          SELECT source_id AS own, target_id AS neighbor, 'out' AS direction, relation_type, confidence FROM {prefix}graph_edges
          UNION ALL SELECT target_id, source_id, 'in', relation_type, confidence FROM {prefix}graph_edges WHERE source_id <> target_id) e
        WHERE e.own = {prefix}neighbors_of.asked""")  # fmt: skip
    steps = [f"SELECT source_id AS start, target_id AS node, 1 AS hops, max(confidence) AS confidence FROM {prefix}graph_edges GROUP BY 1, 2"]
    for k in range(2, max_hops + 1):
        steps.append(f"""SELECT p.start AS start, e.target_id AS node, {k} AS hops, max(p.confidence * e.confidence) AS confidence FROM ({steps[-1]}) p
            JOIN {prefix}graph_edges e ON p.node = e.source_id GROUP BY 1, 2""")  # fmt: skip
    every = " UNION ALL ".join(f"({s})" for s in steps)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}reached_from(asked STRING) RETURNS TABLE (node STRING, hops INT, confidence DOUBLE)
        RETURN SELECT r.node, r.hops, r.confidence FROM (
          SELECT start, node, min(hops) AS hops, max(confidence) AS confidence FROM ({every}) WHERE start <> node GROUP BY start, node) r
        WHERE r.start = {prefix}reached_from.asked""")  # fmt: skip


def register_states(intervals: DataFrame, prefix: str = "") -> None:
    """state_at(object_id, at) over the intervals of state.intervals(): (key, value) of every key that the entity had at that time.

    An interval holds its beginning and not its end. A lateral call is one equi-join on the entity, the time a filter
    behind it; the intervals become the view <prefix>state_intervals.
    """
    spark = intervals.sparkSession
    kind = dict(intervals.dtypes)
    intervals.createOrReplaceTempView(f"{prefix}state_intervals")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}state_at(asked {kind["object_id"]}, at {kind["valid_from"]})
        RETURNS TABLE (key STRING, value {kind["value"]})
        RETURN SELECT i.key, i.value FROM {prefix}state_intervals i
        WHERE i.object_id = {prefix}state_at.asked AND i.valid_from <= {prefix}state_at.at AND ({prefix}state_at.at < i.valid_to OR i.valid_to IS NULL)""")  # fmt: skip
