"""driftglass: document search, passage ranking and replica placement as Spark jobs."""
