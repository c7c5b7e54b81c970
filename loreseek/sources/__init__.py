"""Sources and sinks: git histories, the table store, evaluation cases."""
