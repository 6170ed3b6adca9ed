"""Plain-Python versions of the operators, without regard for speed."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def dedup(rows):
    """rows: (doc_id, text). Sorted (doc_id, keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(folded(t).encode()).hexdigest()].append(i)
    out = []
    for sha, ids in groups.items():
        keep, done = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            stays = i == keep and not done
            done |= stays
            out.append((i, keep, len(ids), stays, sha))
    return out


def quality_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def base_failed(text):
    n, _, _, _, repeated = quality_counts(text)
    return n < 10 or 100 * repeated > 20 * n


def binomial_at_most(k, n, p):
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1)))


def near_groups(rows, threshold=0.8):
    """rows: (doc_id, text) with distinct ids. {doc_id: (least id of its group, links)} over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a_at, a in enumerate(ids):
        for b in ids[a_at + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= threshold * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def mix_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """{source: target}: shares by weight, cut at the cap, the excess given to the others by weight, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        full = {s for s in free if target[s] >= most * sizes[s]}
        for s in full:
            target[s] = float(most * sizes[s])
        free -= full
        if not full:
            break
    return target


def mix_copies(classes, targets, share=1.5, most=2):
    """{(source, size): copies} for classes {(source, size): n}: bisection of the dual, then rounding from the longest size down."""
    start, out = math.log(share / (most - share)), {}
    by = defaultdict(dict)
    for (s, size), n in classes.items():
        if size:
            by[s][size] = n
    for s, sizes in by.items():
        mean = sum(k * n for k, n in sizes.items()) / sum(n for (t, _), n in classes.items() if t == s and _)

        def rate(b, size, mean=mean):
            return most / (1 + math.exp(-max(min(start + b * math.sqrt(size / mean), 40), -40)))

        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            if sum(rate(mid, k) * k * n for k, n in sizes.items()) < targets[s]:
                low = mid
            else:
                high = mid
        full = targets[s] >= most * sum(k * n for k, n in sizes.items())
        over = 0.0
        for size in sorted(sizes, reverse=True):
            n = sizes[size]
            wanted = over + (most if full else rate(low, size)) * n * size
            copies = min(max(math.floor(wanted / size + 0.5), 0), most * n)
            over = wanted - copies * size
            out[s, size] = copies
    return out


def secrets(text, kinds):
    """Spans (start, kind, end) of the fixed kinds, sorted."""
    out = []
    for kind, (_, pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern.replace("(?i:", "(?ai:"), text or ""):
            if len(m.group(group)) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(fields):
    return _sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _root(nodes):
    """(root, for each node its proof as a list of (left, right))."""
    places, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[a:a + 16] for a in range(0, len(nodes), 16)]
        for who, p in enumerate(places):
            run = runs[p // 16]
            proofs[who].append(("".join(run[:p % 16]), "".join(run[p % 16 + 1:])))
            places[who] = p // 16
        nodes = [_sha("".join(r)) for r in runs]
    return nodes[0], proofs


def merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text). Rows of the manifest, sorted by their text form."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0], _leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sub, inner[name] = _root([leaf for _, leaf, _ in trees[name]])
        subs.append(sub)
    root, outer = _root(subs)
    out = []
    for name, sub, over in zip(names, subs, outer):
        for (i, leaf, r), proof in zip(trees[name], inner[name]):
            hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and r[4] is not None
            node = _leaf((*r[:4], folded(r[4]))) if hit else leaf
            path = proof + over
            for left, right in path:
                node = _sha(left + node + right)
            out.append((i, leaf, sub, root, _sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def damage(rows):
    """rows: (conv_id, turn, role, text). Per conv_id its rows (turn, role, text) in order."""
    def plain(x):
        return " " if x is None else str(x)

    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = plain(role), plain(text)
        lot = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        if lot:
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            out[conv] += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], _sha(r[2])))
    return out


def faults(rows):
    """rows: (role, text). One of blank, duplicate, truncated or None for each."""
    seen, out = set(), []
    for r in rows:
        bare = r[1].rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if r in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add(r)
    return out


LAWFUL = re.compile("(s?(ua)+)?")


def all_repairs(rows, most=3):
    """Every (cost, edits, repaired rows) for (role, text) rows with at most ``most`` insertions, by plain search."""
    bad = faults(rows)

    def walk(i, left):
        if left:
            for role in ("user", "assistant"):
                for cost, edits, out in walk(i, left - 1):
                    yield cost + 5, "I" + edits, [(role, ""), *out]
        if i == len(rows):
            yield 0, "", []
            return
        for cost, edits, out in walk(i + 1, left):
            yield cost + 2, "D" + edits, out
            if bad[i] not in ("blank", "duplicate"):
                more = 5 if bad[i] else 0
                yield cost + more, "K" + edits, [rows[i], *out]
                for role in ("user", "assistant"):
                    yield cost + more + 1, "R" + edits, [(role, rows[i][1]), *out]

    return [x for x in walk(0, most) if LAWFUL.fullmatch("".join(r[:1] or "-" for r, _ in x[2]))]


def repaired(rows):
    """(cost, edits, repaired rows) of the cheapest repair, row by row over the four states."""
    bad = faults(rows)
    ahead = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def offer(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def inserted(table):
        for _ in range(2):
            for state, (cost, edits, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in ahead[state]:
                        offer(table, role[0], (cost + 5, edits + "I", (*out, (role, ""))))
        return table

    for (role, text), fault in zip(rows, bad):
        new = {}
        for state, (cost, edits, out) in inserted(best).items():
            offer(new, state, (cost + 2, edits + "D", out))
            if fault not in ("blank", "duplicate"):
                cost += 5 if fault else 0
                if role[:1] in ahead[state]:
                    offer(new, role[0], (cost, edits + "K", (*out, (role, text))))
                for to in ("user", "assistant"):
                    if to[0] in ahead[state] and to[0] != role[:1]:
                        offer(new, to[0], (cost + 1, edits + "R", (*out, (to, text))))
        best = new
    inserted(best)
    cost, edits, out = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    return cost, edits, list(out)


def turn_repair(rows):
    out = []
    for conv, own in damage(rows).items():
        pairs = [r[1:] for r in own]
        bad, turns = Counter(faults(pairs)), [r[0] for r in own if r[0] is not None]
        first = [r[:1] or "-" for r, _ in pairs]
        cost, edits, fixed = repaired(pairs)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad["blank"], bad["duplicate"], bad["truncated"],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, edits, _sha("\n".join(f"{r}:{t}" for r, t in fixed))))
    return sorted(out, key=repr)


def lm_base(rows):
    """rows: (doc_id, text). Sorted (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    end = object()
    tokens = [(i, [*words(folded(t)), end]) for i, t in rows]
    seen = Counter(w for i, own in tokens if not out(i) for w in own)
    n, v = sum(seen.values()), len(seen)
    return sorted(((i, out(i), len(own), sum(seen[w] > 0 for w in own), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own), 6))
                   for i, own in tokens), key=repr)
