"""Nothing streams in the dialect: its row queues are finite and inside one process,
which DataFrame edges already are. The package keeps the place for streaming sources."""
