"""A run as text, the same for the same run."""

from __future__ import annotations

from tapeloom.operators.simulator import Simulator


def render(sim: Simulator) -> str:
    book = sim.book
    lines = [f"bid {book.best('B')} ask {book.best('S')} live {len(book.orders)} hidden {len(sim.hidden)}"]
    lines += [f"level {side} {price} {qty}" for side, price, qty in book.l2()]
    lines += [f"decision {d['seq']} {d['kind']} ref {d['ref']} filled {d['filled']} cancelled {d['cancelled']}" for d in sim.decisions]
    lines += [f"fill {f['seq']} ref {f['ref']} {f['qty']} @ {f['price_ticks']} fee {f['fee']}" for f in sim.fills]
    lines += [f"notional {sim.notional} fees {sim.fees} naive {sim.naive} model {sim.model} aggressive {sim.aggressive}", f"digest {sim.digest().hex()}"]
    return "\n".join(lines) + "\n"
