from tracecairn.plans.run import TraceRun
from tracecairn.plans.schedule import execute_plan, replay_plan

__all__ = ["TraceRun", "execute_plan", "replay_plan"]
