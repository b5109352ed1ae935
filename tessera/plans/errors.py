class PlanValidationError(ValueError):
    """A plan that can't be run, with what is wrong in each of its expressions."""

    def __init__(self, node: str, problems: list[str]):
        self.node, self.problems = node, problems
        super().__init__(f"{node}: " + "; ".join(problems))


class NotSupportedError(ValueError):
    """Query text outside the supported subset."""
