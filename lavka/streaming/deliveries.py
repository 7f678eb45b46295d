"""Rows that a source may deliver again: each taken once, with state bounded by the watermark."""


def once(stream, keys, time, horizon):
    """``stream`` without repeated deliveries: one row per ``keys`` within ``horizon`` of its time.

    The state store holds a key until the watermark has passed its row's time by the
    horizon, so state is as large as what arrives within it, whatever the stream's length. A
    source that repeats a row later than that must not be trusted with it; a row that is itself behind
    the watermark is dropped and counted, see ``late_rows``.
    """
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def late_rows(query):
    """How many rows a query has dropped behind its watermark, over the progress Spark still holds."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def kept_keys(query):
    """How many keys the state holds now."""
    last = query.lastProgress
    return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0
