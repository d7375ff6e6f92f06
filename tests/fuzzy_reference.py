"""Plain-Python similarity scores that the native ones are held against."""


def lcs_length(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); 100 for two empty strings."""
    n = len(a) + len(b)
    if n == 0:
        return 100.0
    return 100.0 * 2.0 * lcs_length(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of: sorted differences against each other, intersection against each side; 100 on containment."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    inter = ta & tb
    dab, dba = ta - tb, tb - ta
    if inter and (not dab or not dba):
        return 100.0
    sab = " ".join(sorted(dab))
    sba = " ".join(sorted(dba))
    sect = len(" ".join(sorted(inter)))
    la = sect + (1 if sect else 0) + len(sab)
    lb = sect + (1 if sect else 0) + len(sba)
    total = la + lb
    dist = len(sab) + len(sba) - 2 * lcs_length(sab, sba)
    best = 100.0 - 100.0 * dist / total if total else 100.0
    if not sect:
        return best
    r_ab = 100.0 - 100.0 * ((1 if sect else 0) + len(sab)) / (sect + la)
    r_ba = 100.0 - 100.0 * ((1 if sect else 0) + len(sba)) / (sect + lb)
    return max(best, r_ab, r_ba)
