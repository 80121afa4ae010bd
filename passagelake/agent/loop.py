"""A bounded loop of a provider and tools over one question, as events; a run is what the events add up to."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

from ..operators.memory import HEAD, tokens_of
from .providers import Message, Provider, ProviderError, Reply, Request, Usage, pieces
from .tools import Call, Registry, Result, Tool


@dataclass(frozen=True)
class LoopOptions:
    turns: int = 8
    budget: int = 8000
    keep_ratio: float = 0.7
    result_chars: int = 20_000
    tool_timeout: float | None = None
    system: str | None = None
    approve: Callable[[Call, Tool], bool] | None = None

    def __post_init__(self):
        if self.turns < 1 or self.budget < 1 or not 0 < self.keep_ratio <= 1:
            raise ValueError(f"turns and budget must be positive, keep_ratio in (0, 1]: {self}")


@dataclass(frozen=True)
class Event:
    """``kind``: text (a piece of the answer), call, result, or done with its stop reason in ``text``."""

    kind: str
    text: str = ""
    call: Call | None = None
    result: Result | None = None


@dataclass
class Run:
    answer: str = ""
    stop: str = ""
    turns: int = 0
    usage: Usage = Usage()
    steps: list[dict] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def cost(m: Message) -> int:
    return tokens_of(m.text) + 4 + sum(tokens_of(c.name) + tokens_of(str(c.arguments)) + 6 for c in m.calls)


def fitted_history(history: Sequence[Message], budget: int, keep_ratio: float) -> list[Message]:
    """The newest messages within the budget's share, and a line for each older one as far as these fit the rest."""
    if sum(map(cost, history)) <= budget:
        return list(history)
    kept, used = [], 0
    for m in reversed(history):
        if kept and used + cost(m) > max(1, int(budget * keep_ratio)):
            break
        kept.append(m)
        used += cost(m)
    lines, room = [], budget - used - tokens_of(HEAD)
    for m in reversed(history[: len(history) - len(kept)]):
        line = f"- {m.role}: {' '.join(m.text.split())[:120]}"
        if m.role != "system" and m.text.strip() and tokens_of(line) <= room:
            lines.append(line)
            room -= tokens_of(line)
    return ([Message("system", HEAD + "\n".join(reversed(lines)))] if lines else []) + kept[::-1]


class Agent:
    def __init__(self, provider: Provider, tools: Registry | None = None, options: LoopOptions = LoopOptions()):
        self.provider, self.tools, self.options = provider, tools or Registry(), options

    def stream(self, question: str, history: Sequence[Message] = (), run: Run | None = None) -> Iterator[Event]:
        """Stops with ``final_answer``, ``max_turns``, ``no_tools`` (calls, but nothing to call) or ``provider_error``."""
        o, run, seen = self.options, run if run is not None else Run(), set()
        messages = [*history, Message("user", question)]
        for run.turns in range(1, o.turns + 1):
            system = [Message("system", o.system)] if o.system else []
            try:
                reply: Reply = self.provider.complete(Request((*system, *fitted_history(messages, o.budget, o.keep_ratio)), self.tools.schemas()))
            except ProviderError as e:
                run.answer, run.stop = str(e), "provider_error"
                break
            run.usage = run.usage + reply.usage
            if reply.text:
                yield from (Event("text", p) for p in pieces(reply.text))
            messages.append(Message("assistant", reply.text, reply.calls))
            if not reply.calls:
                run.answer += reply.text
                if reply.paused:  # the provider goes on in another turn
                    continue
                run.stop = "final_answer"
                break
            if not self.tools.tools:
                run.answer, run.stop = reply.text, "no_tools"
                break
            for call in reply.calls:
                if call.id in seen:
                    continue
                seen.add(call.id)
                yield Event("call", call=call)
                result = self.tools.execute(call, o.result_chars, o.tool_timeout, o.approve)
                run.steps.append({"turn": run.turns, "tool": call.name, "arguments": call.arguments, "is_error": result.is_error, "content": result.content})
                messages.append(Message("tool", result.content, (), call.id, call.name, result.is_error))
                yield Event("result", result=result)
        run.stop = run.stop or "max_turns"
        yield Event("done", run.stop)

    def run(self, question: str, history: Sequence[Message] = ()) -> Run:
        out = Run()
        for _ in self.stream(question, history, out):
            pass
        return out
