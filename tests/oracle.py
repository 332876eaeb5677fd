"""A naive model of the graph semantics on Python strings; shares no code with the engine."""

from __future__ import annotations

COMP = str.maketrans("ACGTacgt", "TGCAtgca")


def rc(s: str) -> str:
    return s.translate(COMP)[::-1]


def canon(s: str) -> str:
    return min(s, rc(s))


def turned(seq: str, rev: bool) -> str:
    return rc(seq) if rev else seq


def spell(nodes, path) -> str:
    _, steps, laps = path
    out = ""
    for i, (n, rev) in enumerate(steps):
        s = turned(nodes[n][0], rev)
        skip = laps[i - 1] if 0 < i <= len(laps) else 0
        out += s[min(skip, len(s)) :]
    return out


def runs(s: str) -> list[str]:
    out, now = [], ""
    for c in s.upper() + "#":
        if c in "ACGT":
            now += c
        else:
            if now:
                out.append(now)
            now = ""
    return out


def words(texts, k: int) -> set[str]:
    return {canon(r[i : i + k]) for t in texts for r in runs(t) for i in range(len(r) - k + 1)}


def arcs(edges):
    out = set()
    for a, ar, b, br, o in edges:
        out.add((a, ar, b, br, o))
        out.add((b, not br, a, not ar, o))
    return out


def walks(nodes, edges, k: int):
    """The spelled bases of all walks, each cut k bases after its first node."""
    nxt = {}
    for a, ar, b, br, o in arcs(edges):
        nxt.setdefault((a, ar), []).append((b, br, o))

    for n in range(len(nodes)):
        for rev in (False, True):
            todo, seen = [((n, rev), turned(nodes[n][0], rev), 0)], set()
            while todo:
                side, text, past = state = todo.pop()
                if state in seen:
                    continue
                seen.add(state)
                yield text
                for b, br, o in nxt.get(side, ()) if past < k else ():
                    piece = turned(nodes[b][0], br)[o:][: k - past]
                    todo.append(((b, br), text + piece, past + len(piece)))


class Dbg:
    """K-mers and (k+1)-mers by rank, and the two ends of each edge."""

    def __init__(self, texts, k):
        texts = list(texts)
        self.k, self.kmers, self.edges = k, sorted(words(texts, k)), sorted(words(texts, k + 1))
        self.id = {x: i for i, x in enumerate(self.kmers)}

    def end(self, w):
        return self.id[canon(w)], rc(w) < w

    def ends(self):
        return [(*self.end(e[:-1]), *self.end(e[1:])) for e in self.edges]

    def successors(self, side):
        """Sides entered by one more base; a palindrome is entered forward."""
        w = turned(self.kmers[side[0]], side[1])
        return [self.end(w[1:] + b) for b in "ACGT" if canon(w + b) in set(self.edges)]

    def unitigs(self, blocked=()):
        """Chains grown from the least unused k-mer, right then left; (sequence, sides) by representative."""
        edges = set(self.edges)
        succ = {}
        for i in range(len(self.kmers)):
            for r in (False, True):
                w = turned(self.kmers[i], r)
                succ[i, r] = [self.end(w[1:] + b) for b in "ACGT" if canon(w + b) in edges]
        flip = lambda s: (s[0], not s[1])
        pal = {i for i, x in enumerate(self.kmers) if rc(x) == x}
        blocked = set(blocked)

        def follow(x):
            if len(succ[x]) != 1:
                return None
            y = succ[x][0]
            if len(succ[flip(y)]) != 1 or y[0] == x[0] or x[0] in pal or y[0] in pal or x in blocked or flip(y) in blocked:
                return None
            return y

        used, out = set(), []
        for i in range(len(self.kmers)):
            if i in used:
                continue
            chain = [(i, False)]
            used.add(i)
            while (y := follow(chain[-1])) and y[0] not in used:
                chain.append(y)
                used.add(y[0])
            back = [(i, True)]
            while (y := follow(back[-1])) and y[0] not in used:
                back.append(y)
                used.add(y[0])
            chain = [flip(s) for s in reversed(back[1:])] + chain
            seq = turned(self.kmers[chain[0][0]], chain[0][1]) + "".join(turned(self.kmers[a], r)[-1] for a, r in chain[1:])
            out.append((seq, chain))
        edges_out = set()
        first = {c[0]: (u, False) for u, (_, c) in enumerate(out)} | {flip(c[-1]): (u, True) for u, (_, c) in enumerate(out)}
        for u, (_, c) in enumerate(out):
            for exit_, rev in ((c[-1], False), (flip(c[0]), True)):
                for y in succ[exit_]:
                    v, vr = first[y]
                    edges_out.add(min((u, rev, v, vr), (v, not vr, u, not rev)))
        return out, edges_out


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]
