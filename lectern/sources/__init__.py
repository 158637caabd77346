"""Sources and sinks, and the adapters that shape the driver's tables as the engine's."""
