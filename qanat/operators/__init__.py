"""DataFrame -> DataFrame operators. No operator collects rows or needs a particular session."""
