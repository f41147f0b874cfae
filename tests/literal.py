"""The same operators as plain loops over one capture, to check against."""

from __future__ import annotations


def literal_pairs(events):
    """``events``: dicts in file order. Returns {(source, index): row}."""
    by_source = {}
    for e in events:
        by_source.setdefault(e["source_id"], []).append(e)
    rows = {}
    for source, own in by_source.items():
        stack = []
        info = [{"depth": 0, "parent": None, "begin": None, "end": None} for _ in own]
        for i, e in enumerate(own):
            if e["phase_name"] == "PHASE_END":
                at = [j for j in range(len(stack)) if own[stack[j]]["type"] == e["type"]]
                if at:
                    info[i]["begin"] = stack[at[-1]]
                    for j in stack[at[-1]:]:
                        info[j]["end"] = i
                    del stack[at[-1]:]
            if stack:
                info[i]["parent"] = stack[-1]
            info[i]["depth"] = len(stack)
            if e["phase_name"] == "PHASE_BEGIN":
                stack.append(i)

        def flat(b):
            end = info[b]["end"]
            return own[b]["phase_name"] == "PHASE_BEGIN" and end == b + 1 and not (
                own[b]["has_params"] and own[end]["has_params"]
            )

        for i, e in enumerate(own):
            x = info[i]
            name = lambda j: None if j is None else own[j]["event_index"]
            rows[(source, e["event_index"])] = (
                x["depth"],
                name(x["parent"]),
                name(x["begin"]),
                name(x["end"]),
                None if x["end"] is None else own[x["end"]]["time_ticks"],
                flat(i),
                e["phase_name"] == "PHASE_END" and x["begin"] is not None and flat(x["begin"]),
            )
    return rows


def literal_counts(events, wanted, ssl=False):
    """Open-source counts: ``wanted(e)`` picks the events."""
    active, points = set(), []
    for e in events:
        freed = ssl and e["type_name"] == "SSL_CONNECT" and e["phase_name"] == "PHASE_END"
        if not freed and not wanted(e):
            continue
        before = len(active)
        if freed or e["phase_name"] == "PHASE_END":
            active.discard(e["source_id"])
        elif e["phase_name"] == "PHASE_BEGIN":
            active.add(e["source_id"])
        if len(active) != before:
            points.append((e["event_index"], float(len(active))))
    return points


SECOND = {"UDP_CONNECT", "IPV6_PROBE_RUNNING", "SOCKET_POOL_CONNECT_JOB_CREATED", "CERT_VERIFY_PROC"}


def literal_descriptions(events):
    """Descriptions by replaying one capture; events are dicts with ``params`` or None."""
    own, text = {}, {}

    def start_of(rows):
        if not rows:
            return None
        kind = rows[0]["source_type_name"]
        if kind == "FILESTREAM":
            opened = [e for e in rows if e["type_name"] == "FILE_STREAM_OPEN"]
            if opened:
                return opened[0]
        if kind == "DOWNLOAD":
            renamed = [e for e in rows if e["type_name"] == "DOWNLOAD_FILE_RENAMED" and e["phase_name"] != "PHASE_END"]
            if renamed:
                return renamed[-1]
            for name in ("DOWNLOAD_FILE_OPENED", "DOWNLOAD_ITEM_ACTIVE"):
                found = [e for e in rows if e["type_name"] == name]
                if found:
                    return found[0]
        return rows[1] if len(rows) > 1 and rows[1]["type_name"] in SECOND else rows[0]

    def dependency(params):
        return (params or {}).get("source_dependency", {}).get("id")

    def describe(source):
        e = start_of(own[source])
        kind, p = e["source_type_name"], e["params"]
        if kind == "NONE":
            return e["type_name"]
        if p is None:
            return ""
        if kind == "URL_REQUEST":
            return p.get("url", "")
        if kind == "HOST_RESOLVER_IMPL_JOB":
            return p.get("host", "")
        if kind == "SOCKET":
            return text.get(dependency(p), "")
        if kind == "HTTP_STREAM_POOL_ATTEMPT_MANAGER":
            if dependency(p) is not None:
                return text.get(dependency(p), "")
            return p.get("stream_key", {}).get("destination", "")
        if kind == "UDP_SOCKET":
            if "address" not in p:
                return ""
            first = own[source][0]
            up = dependency(first["params"]) if first["type_name"] == "SOCKET_ALIVE" else None
            if up in text and own[up][0]["source_type_name"] == "HOST_RESOLVER_IMPL_JOB" and text[up]:
                return f"{p['address']} [{text[up]}]"
            return p["address"]
        if kind == "DOWNLOAD":
            field = {"DOWNLOAD_FILE_RENAMED": "new_filename"}.get(e["type_name"], "file_name")
            return p.get(field, "") if e["type_name"].startswith("DOWNLOAD_") else ""
        return ""

    for e in events:
        source = e["source_id"]
        rows = own.setdefault(source, [])
        before = start_of(rows)
        rows.append(e)
        if start_of(rows) is not before:
            # a new source is not yet known to itself while it is described
            text[source] = describe(source)
    return text
