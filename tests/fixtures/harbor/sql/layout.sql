create table quay (
  code CHAR(4),
  depth DECIMAL(5,2) COMMENT 'Metres at low tide'
);

CREATE TABLE IF NOT EXISTS `pallets` (
  `pallet_no` BIGINT NOT NULL COMMENT 'Painted number',
  bound VARCHAR(20) DEFAULT 'none',
  mass DOUBLE COMMENT 'Kilograms',
  UNIQUE KEY by_bound (bound),
  CONSTRAINT pk PRIMARY KEY (pallet_no)
);
