"""Plain one-record-at-a-time versions of the operators, to test against."""


def parse(message):
    parts = [p.strip() for p in message.strip("{").strip("}").strip().split("``")]
    return parts


def choose(parts, left):
    """Key taken and status, given the keys left as ``{key: path}``."""
    if len(parts) < 6:
        return None, "malformed"
    if parts[3] != "1":
        return None, "done"
    exact = f"{parts[5]}:{parts[4]}"
    if exact in left:
        return exact, "exact"
    ending = sorted(k for k in left if k.endswith(f":{parts[4]}"))
    return (ending[0], "suffix") if ending else (None, "not_found")


def find(path, name, records):
    """Smallest record of the path with that name, else with that base name."""
    here = sorted((r for r in records if r["path"] == path), key=lambda r: r["record_no"])
    for same in (lambda r: r["name"] == name, lambda r: r["name"].split(":")[-1] == name.split(":")[-1]):
        for r in here:
            if same(r):
                return r
    return None


def walk(records, drop_seed=False, max_steps=None):
    """``(project, step, record_no)`` of the whole walk."""
    out = []
    for project in sorted({r["project"] for r in records}):
        own = [r for r in records if r["project"] == project]
        left = {f"{r['path']}:{r['name']}": r["path"] for r in own}
        now, step = min(own, key=lambda r: r["record_no"]), 0
        if drop_seed:
            left.pop(f"{now['path']}:{now['name']}", None)
        while now is not None and (max_steps is None or step < max_steps):
            out.append((project, step, now["record_no"]))
            parts = parse(now["review_message"])
            key, _ = choose(parts, left)
            if key is None:
                break
            now, step = find(left.pop(key), parts[4], own), step + 1
    return sorted(out)


def serve(messages, index, taken=()):
    """Serve messages ``(project, seq, text)`` one after the other: rows of ``(project, seq, status, key)``."""
    left = {p: dict(keys) for p, keys in index.items()}
    for project, key in taken:
        left[project].pop(key, None)
    out = []
    for project, seq, text in sorted(messages):
        key, status = choose(parse(text), left[project])
        if key is not None:
            left[project].pop(key)
        out.append((project, seq, status, key))
    return sorted(out)


def chunks(text, limit):
    """``(first_line, last_line, content)`` of greedy packing."""
    lines = text.split("\n")
    lines = [x[:-1] if x.endswith("\r") and i < len(lines) - 1 else x for i, x in enumerate(lines)]
    if lines and lines[-1] == "":
        lines.pop()
    out, body, first = [], b"", 1
    for no, line in enumerate(lines, 1):
        numbered = f"{no:>6}: {line}\n".encode()
        if body and len(body) + len(numbered) > limit:
            out.append((first, no - 1, body.decode()))
            body, first = b"", no
        body += numbered
    if body:
        out.append((first, len(lines), body.decode()))
    return out
