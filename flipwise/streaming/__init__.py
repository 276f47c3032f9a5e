"""flipwise.streaming: the profiling operators on a Structured Streaming source."""
