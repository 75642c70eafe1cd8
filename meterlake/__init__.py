"""Token-usage analytics for fleets of coding agents, written as Spark DataFrame jobs."""
