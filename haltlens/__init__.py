"""Early-stop analytics over ordered multi-step runs, on Spark."""
