"""What the engine raises."""


class DataStop(Exception):
    """A data rule that stops a load: its name and what broke it."""

    def __init__(self, rule: str, detail: str):
        super().__init__(f"{rule}: {detail}")
        self.rule, self.detail = rule, detail


class ManifestError(Exception):
    """A snapshot and its manifest disagree."""


class SourceFormatError(Exception):
    """A publisher's file does not have its format."""


class Refusal(ValueError):
    """A computation that has no answer on its input; a run that meets one is cut."""
