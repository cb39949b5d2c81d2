"""Views of the driver tables as facts, registered queries and report sinks."""
