from .explain import plan_changes, plan_nodes, plan_operator_changes

__all__ = ["plan_changes", "plan_nodes", "plan_operator_changes"]
