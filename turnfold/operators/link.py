"""A request over the link: what is framed, what the peer asks for again, and when the body goes whole."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import codec
from ..functions.codec import FRAME_COST, Tag
from .splitting import RAW, Rebuild, Session, digest, missing, resolve
from .store import Blocks, Store

MAX_REPAIRS, MAX_NEST = 4, 32


@dataclass
class Peer:
    """The far end: blocks within the bounds of its store."""

    store: Store = field(default_factory=Store)
    blocks: Blocks = field(default_factory=Blocks)
    now: int = 0

    def __post_init__(self):
        self.store.forget = self.blocks.remove

    def take(self, tag: Tag, payload: bytes) -> None:
        """A block's frame. What the store lets go of is forgotten here too."""
        tag, payload = codec.received(tag, payload)
        d, kind, size, block = codec.decode_block(payload)
        self.now += 1
        if d in self.store.entries:
            self.store.touch(d, self.now)
        else:
            self.blocks.put(d, kind, size, block)
            if not self.store.insert(d, size, self.now):
                self.blocks.remove(d)

    def rebuilt(self, program: list, body_len: int, body_digest: bytes) -> tuple[bytes | None, list[bytes]]:
        """The declared body, or null and what to ask for: all that the program lacks, or, where only blocks
        inside its blocks are lacking, the first of those. Nothing to ask for means that the body is another one."""
        if need := missing(self.blocks, program):
            return None, need
        try:
            body = resolve(self.blocks, program, body_len + 1, MAX_NEST)
        except Rebuild as e:
            return None, [e.digest] if e.digest else []
        return (body if len(body) == body_len and digest(RAW, body) == body_digest else None), []

    def reset(self) -> int:
        self.blocks.clear()
        return self.store.clear()


@dataclass
class Sent:
    outcome: str = "whole"  # whole, split, repaired, or resent whole
    reason: str | None = None
    repairs: int = 0
    resent: int = 0
    wire: int = 0
    body: bytes = b""


@dataclass
class Link:
    """The near end: its session, and the blocks it can send again."""

    session: Session = field(default_factory=Session)
    peer: Peer = field(default_factory=Peer)
    known: Blocks = field(default_factory=Blocks)
    compress: bool = True

    def _frame(self, sent: Sent, tag: Tag, payload: bytes = b"") -> tuple[Tag, bytes]:
        tag, payload = codec.upload(tag, payload, self.compress)
        sent.wire += len(payload) + FRAME_COST
        return tag, payload

    def _push(self, sent: Sent, d: bytes) -> None:
        kind, size, block = self.known[d]
        self.peer.take(*self._frame(sent, Tag.BLOCK_BYTES if isinstance(block, bytes) else Tag.BLOCK_PROGRAM, codec.encode_block(d, kind, size, block)))

    def send(self, body: bytes) -> Sent:
        """One request. At most MAX_REPAIRS times the peer names what it lacks and gets it again; if blocks
        are lacking still, the session forgets what it noted. A body that can't be rebuilt goes whole."""
        sent = Sent()
        sent.reason, program, push, _ = self.session.split(body)
        if sent.reason is None:
            self.known |= push
            declared = len(body), digest(RAW, body)
            _, raw = codec.received(*self._frame(sent, Tag.PROGRAM, codec.encode_program(program)))
            for d in push:
                self._push(sent, d)
            self._frame(sent, Tag.END_OF_BODY)
            program = codec.decode_program(raw)
            back, need = self.peer.rebuilt(program, *declared)
            while need and sent.repairs < MAX_REPAIRS:
                sent.repairs += 1
                for d in codec.decode_digests(codec.encode_digests(need)):
                    if d in self.known:
                        sent.resent += 1
                        self._push(sent, d)
                self._frame(sent, Tag.END_OF_BODY)
                back, need = self.peer.rebuilt(program, *declared)
            if back is not None:
                sent.outcome, sent.body = "repaired" if sent.repairs else "split", back
                return sent
            if need:
                self.session.noted.clear()
            sent.outcome, sent.reason = "resent whole", "rebuild failed"
        _, sent.body = codec.received(*self._frame(sent, Tag.REQUEST_BODY, body))
        self._frame(sent, Tag.END_OF_BODY)
        return sent
