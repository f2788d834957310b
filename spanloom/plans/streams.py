"""Streaming queries, run over stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RuntimeConfig
from ..functions import attrs as A
from ..storage import new_path
from ..streaming import assembler
from .records import table
from .traces import clean_spans_sql


def stream_assembly(spark, sf_dir):
    """ST1-ST6, ST8, ST10: deliveries assembled as a stream; how many traces were completed, for which reason, and late spans.

    The file source replays the table by arrival; what is open at its end is flushed from the state store.
    """
    static = table(spark, sf_dir, "otel_spans")
    landed = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/otel_spans.parquet*")
    config, out = RuntimeConfig(prefix=A.collector_prefix(static)), new_path(spark, "stream")
    assembler.run_available(landed, f"{out}/rows", f"{out}/checkpoint", config)
    now = static.agg(F.max(F.unix_millis(F.col("received_at").cast("timestamp")))).first()[0] or 0
    rows = spark.read.schema(assembler.OUT).parquet(f"{out}/rows").unionByName(assembler.flush(spark, f"{out}/checkpoint", now, config))
    return rows.groupBy("complete_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("n_spans").cast("long").alias("n_spans"), F.sum("n_dropped").cast("long").alias("n_dropped"))


def queries() -> dict:
    return {"stream_assembly": stream_assembly}


def oracle_sql() -> dict[str, str]:
    """The rules as a recursion over each trace's arrivals in order; one row of ``w`` is the state after an arrival."""
    c = RuntimeConfig()
    settle, idle, age, remember = (int(1000 * x) for x in (c.settle_s, c.idle_s, c.max_age_s, c.remember_s))
    due = lambda p="": f"CASE WHEN {p}root >= 0 THEN {p}root + {settle} ELSE least({p}last + {idle}, {p}first + {age}) END"
    why = lambda p="": f"CASE WHEN {p}root >= 0 THEN 'explicit' WHEN {p}last + {idle} <= {p}first + {age} THEN 'idle' ELSE 'max_age' END"
    return {
        "stream_assembly": f"""WITH RECURSIVE {clean_spans_sql(copies=True)},
      a AS (SELECT trace_id, CAST(epoch_ms(received_at) AS BIGINT) AS ms, role = 'root' AS is_r, role IN ('skip', 'other', 'llm', 'tool') AS weak, row_number() OVER (PARTITION BY trace_id ORDER BY epoch_ms(received_at), span_id, role) AS k FROM s WHERE received_at IS NOT NULL),
      w AS (SELECT trace_id, k, ms AS first, ms AS last, CASE WHEN is_r THEN ms ELSE -1 END AS root, -1::BIGINT AS closed, 1 AS n, CASE WHEN weak THEN 1 ELSE 0 END AS n_weak, 0 AS dropped, NULL::VARCHAR AS done, 0 AS done_n, 0 AS done_dropped, false AS late FROM a WHERE k = 1
        UNION ALL SELECT trace_id, k, CASE WHEN fresh THEN ms ELSE first END, CASE WHEN fresh THEN ms WHEN open THEN greatest(last, ms) ELSE last END, CASE WHEN NOT open THEN -1 WHEN is_r THEN ms WHEN fresh THEN -1 ELSE root END, CASE WHEN open THEN -1 ELSE shut END,
          CASE WHEN NOT open THEN 0 WHEN fresh THEN 1 WHEN n < {c.max_spans} THEN n + 1 WHEN is_r AND n_weak = 0 THEN n + 1 ELSE n END,
          CASE WHEN NOT open THEN 0 WHEN fresh THEN CASE WHEN weak THEN 1 ELSE 0 END WHEN n < {c.max_spans} THEN n_weak + CASE WHEN weak THEN 1 ELSE 0 END WHEN is_r AND n_weak > 0 THEN n_weak - 1 ELSE n_weak END,
          CASE WHEN fresh THEN 0 WHEN NOT open OR n < {c.max_spans} OR (is_r AND n_weak = 0) THEN dropped ELSE dropped + 1 END, CASE WHEN closes THEN reason END, CASE WHEN closes THEN n ELSE 0 END, CASE WHEN closes THEN dropped ELSE 0 END, NOT open
        FROM (SELECT *, shut >= 0 AND ms >= shut + {remember} AS fresh, shut < 0 OR ms >= shut + {remember} AS open FROM
          (SELECT a.trace_id, a.k, a.ms, a.is_r, a.weak, first, last, root, n, n_weak, dropped, closed < 0 AND a.ms >= {due('w.')} AS closes, CASE WHEN closed >= 0 THEN closed WHEN a.ms >= {due('w.')} THEN {due('w.')} ELSE -1 END AS shut, {why('w.')} AS reason
           FROM w JOIN a ON a.trace_id = w.trace_id AND a.k = w.k + 1))),
      z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY k DESC) = 1),
      o AS (SELECT done AS complete_reason, done_n AS n_spans, done_dropped AS n_dropped FROM w WHERE done IS NOT NULL UNION ALL SELECT 'late', 1, 0 FROM w WHERE late
        UNION ALL SELECT CASE WHEN {due()} < (SELECT max(ms) FROM a) THEN {why()} ELSE 'shutdown' END, n, dropped FROM z WHERE closed < 0)
      SELECT complete_reason, count(*) AS n, CAST(sum(n_spans) AS BIGINT) AS n_spans, CAST(sum(n_dropped) AS BIGINT) AS n_dropped FROM o GROUP BY complete_reason"""
    }
