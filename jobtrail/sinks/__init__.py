"""Writers: event log, outbox, replay output."""
