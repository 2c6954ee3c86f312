"""The rules of chess: positions, legal moves, notation.  Squares are 0..63 from a1 to h8; pieces are the letters of FEN."""

from __future__ import annotations

import re
from typing import NamedTuple

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
FILES = "abcdefgh"
_KNIGHT = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]
_ROOK = [(1, 0), (-1, 0), (0, 1), (0, -1)]
_BISHOP = [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def _inside(f: int, r: int) -> bool:
    return 0 <= f < 8 and 0 <= r < 8


_steps = {
    "n": [[8 * (r + y) + f + x for x, y in _KNIGHT if _inside(f + x, r + y)] for r in range(8) for f in range(8)],
    "k": [[8 * (r + y) + f + x for x, y in _ROOK + _BISHOP if _inside(f + x, r + y)] for r in range(8) for f in range(8)],
}


def _ray(f: int, r: int, x: int, y: int) -> list[int]:
    out = []
    while _inside(f + x, r + y):
        f, r = f + x, r + y
        out.append(8 * r + f)
    return out


_rays = {k: [[ray for x, y in d if (ray := _ray(f, r, x, y))] for r in range(8) for f in range(8)] for k, d in (("r", _ROOK), ("b", _BISHOP), ("q", _ROOK + _BISHOP))}


def name(sq: int) -> str:
    return FILES[sq & 7] + str((sq >> 3) + 1)


def square(text: str) -> int:
    return FILES.index(text[0]) + 8 * (int(text[1]) - 1)


class Move(NamedTuple):
    start: int
    end: int
    promotion: str = ""

    def uci(self) -> str:
        return name(self.start) + name(self.end) + self.promotion


def from_uci(text: str) -> Move:
    return Move(square(text[:2]), square(text[2:4]), text[4:].lower())


class Position:
    """An immutable-by-convention position; ``after`` gives a new one."""

    __slots__ = ("at", "white", "castling", "passant", "half", "full")

    def __init__(self, at: list[str], white: bool, castling: str, passant: int, half: int, full: int):
        self.at, self.white, self.castling, self.passant, self.half, self.full = at, white, castling, passant, half, full

    @classmethod
    def of(cls, fen: str = START) -> Position:
        """A position from FEN; ValueError for anything that is none."""
        part = fen.split()
        if len(part) < 4 or part[0].count("/") != 7 or part[1] not in ("w", "b"):
            raise ValueError(f"no position: {fen!r}")
        at = [""] * 64
        for r, row in zip(range(7, -1, -1), part[0].split("/")):
            f = 0
            for c in row:
                if c.isdigit():
                    f += int(c)
                elif c in "pnbrqkPNBRQK" and f < 8:
                    at[8 * r + f] = c
                    f += 1
                else:
                    raise ValueError(f"no position: {fen!r}")
            if f != 8:
                raise ValueError(f"no position: {fen!r}")
        if at.count("K") != 1 or at.count("k") != 1:
            raise ValueError("each side needs one king")
        return cls(at, part[1] == "w", "" if part[2] == "-" else part[2], -1 if part[3] == "-" else square(part[3]), int(part[4]) if len(part) > 4 else 0, int(part[5]) if len(part) > 5 else 1)

    def placement(self) -> str:
        rows = []
        for r in range(7, -1, -1):
            row = "".join(self.at[8 * r + f] or "1" for f in range(8))
            rows.append(re.sub("1+", lambda m: str(len(m[0])), row))
        return "/".join(rows)

    def fen(self) -> str:
        return f"{self.placement()} {'w' if self.white else 'b'} {self.castling or '-'} {name(self.passant) if self.passant >= 0 else '-'} {self.half} {self.full}"

    def ply(self) -> int:
        """Half moves before this position."""
        return 2 * (self.full - 1) + (not self.white)

    def attacked(self, sq: int, by_white: bool) -> bool:
        at = self.at
        n, k = ("N", "K") if by_white else ("n", "k")
        if any(at[s] == n for s in _steps["n"][sq]) or any(at[s] == k for s in _steps["k"][sq]):
            return True
        f, r = sq & 7, sq >> 3
        y, pawn = (r - 1, "P") if by_white else (r + 1, "p")
        if 0 <= y < 8 and any(0 <= x < 8 and at[8 * y + x] == pawn for x in (f - 1, f + 1)):
            return True
        for kind in "rb":
            own = ("R" if kind == "r" else "B", "Q") if by_white else (kind, "q")
            for ray in _rays[kind][sq]:
                for s in ray:
                    if at[s]:
                        if at[s] in own:
                            return True
                        break
        return False

    def check(self) -> bool:
        return self.attacked(self.at.index("K" if self.white else "k"), not self.white)

    def _pseudo(self):
        at, white = self.at, self.white
        for s, p in enumerate(at):
            if not p or p.isupper() != white:
                continue
            kind = p.lower()
            if kind == "p":
                step, home, last = (8, 1, 7) if white else (-8, 6, 0)
                ends = []
                e = s + step
                if 0 <= e < 64 and not at[e]:
                    ends.append(e)
                    if s >> 3 == home and not at[e + step]:
                        ends.append(e + step)
                for x in (-1, 1):
                    if 0 <= (s & 7) + x < 8 and 0 <= e + x < 64 and (at[e + x] and at[e + x].isupper() != white or e + x == self.passant):
                        ends.append(e + x)
                for e in ends:
                    if e >> 3 == last:
                        for q in "qrbn":
                            yield Move(s, e, q)
                    else:
                        yield Move(s, e)
            elif kind in "nk":
                for e in _steps[kind][s]:
                    if not at[e] or at[e].isupper() != white:
                        yield Move(s, e)
            else:
                for ray in _rays[kind][s]:
                    for e in ray:
                        if not at[e]:
                            yield Move(s, e)
                        else:
                            if at[e].isupper() != white:
                                yield Move(s, e)
                            break
        row = 0 if white else 56
        king, rook = ("K", "R") if white else ("k", "r")
        if at[row + 4] == king and not self.attacked(row + 4, not white):
            if king in self.castling and at[row + 7] == rook and not at[row + 5] and not at[row + 6] and not self.attacked(row + 5, not white):
                yield Move(row + 4, row + 6)
            if ("Q" if white else "q") in self.castling and at[row] == rook and not at[row + 1] and not at[row + 2] and not at[row + 3] and not self.attacked(row + 3, not white):
                yield Move(row + 4, row + 2)

    def after(self, m: Move) -> Position:
        at = list(self.at)
        p = at[m.start]
        taken = at[m.end]
        at[m.end], at[m.start] = (m.promotion.upper() if self.white else m.promotion) if m.promotion else p, ""
        passant = -1
        if p in "Pp":
            if m.end == self.passant:
                at[m.end + (-8 if self.white else 8)] = ""
            if abs(m.end - m.start) == 16:
                passant = (m.start + m.end) // 2
        elif p in "Kk" and abs(m.end - m.start) == 2:
            a, b = (m.end + 1, m.end - 1) if m.end > m.start else (m.end - 2, m.end + 1)
            at[b], at[a] = at[a], ""
        castling = self.castling
        if castling:
            lost = {4: "KQ", 60: "kq", 0: "Q", 7: "K", 56: "q", 63: "k"}
            for s in (m.start, m.end):
                for c in lost.get(s, ""):
                    castling = castling.replace(c, "")
        return Position(at, not self.white, castling, passant, 0 if p in "Pp" or taken else self.half + 1, self.full + (not self.white))

    def legal(self) -> list[Move]:
        out = []
        for m in self._pseudo():
            nxt = self.after(m)
            if not nxt.attacked(nxt.at.index("K" if self.white else "k"), not self.white):
                out.append(m)
        return out

    def captures(self, m: Move) -> bool:
        return bool(self.at[m.end]) or self.at[m.start] in "Pp" and m.end == self.passant

    def gives_check(self, m: Move) -> bool:
        return self.after(m).check()

    def mate(self) -> bool:
        return self.check() and not self.legal()

    def san(self, m: Move, legal: list[Move] | None = None, marks: bool = True) -> str:
        p = self.at[m.start].upper()
        if p == "K" and abs(m.end - m.start) == 2:
            out = "O-O" if m.end > m.start else "O-O-O"
        elif p == "P":
            out = (FILES[m.start & 7] + "x" if self.captures(m) else "") + name(m.end) + ("=" + m.promotion.upper() if m.promotion else "")
        else:
            rivals = [x.start for x in (legal or self.legal()) if x.end == m.end and x.start != m.start and self.at[x.start] == self.at[m.start]]
            who = ""
            if rivals:
                if not any(r & 7 == m.start & 7 for r in rivals):
                    who = FILES[m.start & 7]
                elif not any(r >> 3 == m.start >> 3 for r in rivals):
                    who = str((m.start >> 3) + 1)
                else:
                    who = name(m.start)
            out = p + who + ("x" if self.captures(m) else "") + name(m.end)
        if marks:
            nxt = self.after(m)
            if nxt.check():
                out += "+" if nxt.legal() else "#"
        return out

    def long(self, m: Move) -> str:
        """Long notation: both squares, - or x."""
        p = self.at[m.start].upper()
        return ("" if p == "P" else p) + name(m.start) + ("x" if self.captures(m) else "-") + name(m.end) + m.promotion.upper()

    def read(self, text: str, legal: list[Move] | None = None) -> Move | None:
        """The one legal move that English notation names (short, long, ``ed`` for a pawn's capture); None if there is no
        such move or several, and for an ``x`` that takes nothing."""
        t = text.replace("0", "O") if re.fullmatch(r"[0O]-[0O](-[0O])?[+#]?", text) else text
        t = t.rstrip("+#!?")
        legal = legal if legal is not None else self.legal()
        if t in ("O-O", "O-O-O"):
            row = 0 if self.white else 56
            want = Move(row + 4, row + (6 if t == "O-O" else 2))
            return want if want in legal and self.at[row + 4] in "Kk" else None
        m = re.fullmatch(r"([KQRBN]?)([a-h]?)([1-8]?)([-x:]?)([a-h][1-8])(?:=?([QRBN]))?", t)
        if m:
            piece, f, r, sign, end, promo = m.groups()
            found = [x for x in legal if x.end == square(end) and self.at[x.start].upper() == (piece or "P") and (not f or FILES[x.start & 7] == f) and (not r or str((x.start >> 3) + 1) == r) and x.promotion == (promo or "").lower()]
            if not piece and r and not f:
                return None  # a pawn is never told by its row alone
            if sign in ("x", ":"):
                found = [x for x in found if self.captures(x)]
            return found[0] if len(found) == 1 else None
        m = re.fullmatch(r"([a-h])x?([a-h])(?:=?([QRBN]))?", t)
        if m:
            found = [x for x in legal if self.at[x.start] in "Pp" and FILES[x.start & 7] == m[1] and FILES[x.end & 7] == m[2] and self.captures(x) and (not m[3] or x.promotion == m[3].lower())]
            return found[0] if len(found) == 1 else None
        return None


def perft(p: Position, depth: int) -> int:
    """Number of move sequences of a length."""
    moves = p.legal()
    return len(moves) if depth == 1 else sum(perft(p.after(m), depth - 1) for m in moves)


def mirrored(placement: str) -> str:
    """A board seen from the other side."""
    return placement[::-1]


def possible_castling(p: Position) -> list[str]:
    """Castling rights that the placement allows."""
    at = p.at
    return [c for c, k, r, kk, rr in (("K", 4, 7, "K", "R"), ("Q", 4, 0, "K", "R"), ("k", 60, 63, "k", "r"), ("q", 60, 56, "k", "r")) if at[k] == kk and at[r] == rr]


def possible_passant(p: Position) -> list[int]:
    """Squares that a double step just made could have passed and that a pawn may take on."""
    row, step, enemy, own = (5, -8, "p", "P") if p.white else (2, 8, "P", "p")
    out = []
    for f in range(8):
        s = 8 * row + f
        pawn, home = s + step, s - step
        if p.at[pawn] == enemy and not p.at[s] and not p.at[home] and any(0 <= f + x < 8 and p.at[pawn + x] == own for x in (-1, 1)):
            out.append(s)
    return out


def starting_positions(placement: str, number: int, black: bool, first: str, read=None) -> list[tuple[str, str]]:
    """(FEN, orientation) of all set-ups a diagram may mean for which the first printed move is legal: both
    orientations, all subsets of possible castling rights, all possible en passant squares."""
    read = read or (lambda p, w: p.read(w))
    out = []
    for side, text in (("white", placement), ("black", mirrored(placement))):
        try:
            base = Position.of(f"{text} {'b' if black else 'w'} - - 0 {max(1, number)}")
        except ValueError:
            continue
        if base.attacked(base.at.index("k" if base.white else "K"), base.white):
            continue
        rights = possible_castling(base)
        for k in range(1 << len(rights)):
            castling = "".join(c for i, c in enumerate(rights) if k >> i & 1)
            for passant in (-1, *possible_passant(base)):
                p = Position(base.at, base.white, castling, passant, 0, base.full)
                if read(p, first) is not None:
                    out.append((p.fen(), side))
    return out
