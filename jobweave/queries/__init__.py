"""Every operator applied to the driver's tables, with equivalent SQL."""
